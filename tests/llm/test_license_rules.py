"""Every rule of the license scan on a text of its own, plain and wrapped, and SPDX expressions."""

import re
from re import _constants as K
from re import _parser as parser

from breakline.llm import license_scan
from breakline.llm.license_rules import ANCHORS, rules


def sample(tree, most):
    """A text that the pattern matches, with as few or as many of its optional parts as there are."""
    out = ""
    for op, arg in tree:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.IN:
            kind, value = arg[-1 if most else 0]
            out += {K.LITERAL: lambda v: chr(v), K.RANGE: lambda v: chr(v[0]), K.CATEGORY: lambda v: "2"}[kind](value)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            lo, hi, inner = arg
            out += sample(inner, most) * (min(hi, max(lo, 1)) if most else lo)
        elif op is K.BRANCH:
            out += sample(arg[1][-1 if most else 0], most)
        elif op is K.SUBPATTERN:
            out += sample(arg[3], most)
        elif op is K.ANY:
            out += "x"
    return out


def plain(text):
    """Labels by brute force over a text on one line."""
    low = text.lower()
    found = sorted((m.start(m.re.groups), -m.end(), -r["priority"], r["ordinal"], r["label"]) for r in rules() for m in re.finditer(r["pattern"], low))
    return {d[4] for i, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:i])}


def labels(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (set(filter(None, r.labels.split(","))), set(filter(None, r.base_labels.split(",")))) for r in rows}


def test_every_rule_on_plain_and_wrapped_texts(spark):
    texts = []
    for r in rules():
        for most in (False, True):
            # The SPDX prefix is given here, as the samples of its lists of ids are no licenses.
            pattern = r["pattern"] if not r["grouped"] else "spdx-license-identifier: " + r["pattern"].split("{0,200}?")[1]
            text = sample(parser.parse(pattern.replace(r"(?![-\w]|\.\w)", "").replace("(?! attribution)", "")), most)
            assert re.search(r["pattern"], text) and r["need"] in text and any(a in text for a in ANCHORS), (r, text)
            texts.append(text)
    forms = [lambda t: t, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\n"), lambda t: t.upper().replace(" ", "\r\n * "), lambda t: t.replace(" ", "\n# ")]
    got = labels(spark, [f(t) for t in texts for f in forms])
    for i, text in enumerate(texts):
        for j in range(len(forms)):
            found, base = got[i * len(forms) + j]
            assert found == plain(text) | base and found, (text, j)


SPDX = {
    "MIT OR Apache-2.0": {"mit", "apache-2.0"},
    "(MIT OR Apache-2.0)": {"mit", "apache-2.0"},
    "(MIT AND (BSD-3-Clause OR GPL-2.0+)) OR ISC.": {"mit", "bsd-3-clause", "gpl-2.0", "isc"},
    "GPL-2.0-only WITH Classpath-exception-2.0 OR MIT": {"gpl-2.0", "mit"},
    "MIT/Apache-2.0": {"mit", "apache-2.0"},
    "LicenseRef-own AND MIT": {"mit"},
    "MIT-own": set(),
    "foo MIT": set(),
}


def test_spdx_expressions(spark):
    got = labels(spark, [f"# SPDX-License-Identifier: {x}" for x in SPDX])
    assert [got[i][0] for i in range(len(SPDX))] == list(SPDX.values())


NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights"""


def test_wrapped_notices(spark):
    texts = [NOTICE, "the GNU\n// General  Public\n// License, version 2", "Mozilla\nPublic License,\n v. 2.0", "an Open RAIL-M license", "apache.org/licenses/LICENSE-1.0", "opendatacommons.org/licenses/by"]
    got = labels(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [{"x11"}, {"gpl", "gpl-2.0"}, {"mpl-2.0"}, {"openrail"}, {"apache-1.1"}, {"odc-by-1.0"}]
