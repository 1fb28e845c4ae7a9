"""Parameters of structural-variant calling, with an INI overlay."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CallConfig:
    # Filter options
    max_split: int = 10
    min_pid: float = 0.7
    min_mapq: int = 20
    # Detection options
    cluster_distance: int = 10
    cluster_count: int = 2
    refreads_distance: int = 100
    hanging_length: int = 20
    mate_distance: int = 300
    depth_support: bool = True
    min_indel_size: int = 30
    # Output filter options
    qual_flag: int = 20
    window_size: int = 1000
    svcluster: int = 2
    mapq_flag: int = 80
    pid_flag: float = 0.80
    gap_flag: int = 100
    ci_flag: int = 30
    # Phasing options
    phasing_on: bool = False
    variant_bin_size: int = 1_000_000
    phasing_window: int = 7000
    min_coverage: int = 10
    max_deletions: float = 0.25
    min_occurences_of_var: float = 0.4
    min_highq_var: float = 0.6
    min_base_qual_ph: int = 11
    clustering_cutoff: float = 0.3
    # Where a quirk of the parity register has another reading; the defaults are those of the register.
    #: Side 1's hanging ends are looked up at the second position.
    fix_hanging: bool = False
    #: Only junctions on one contig can be insertions.
    one_contig_insertions: bool = False
    #: The clip behind a chunk counts the insertions that were cut out, as the clip ahead of it does.
    count_cut_insertions: bool = False
    #: Breakends of one variant with the same contig and bounds are one, that of side 1.
    merge_equal_breakends: bool = False
    #: The start of a BED line of the SNP file is a position as it is.
    bed_start_is_position: bool = False

    @classmethod
    def read(cls, *paths: str) -> CallConfig:
        """Defaults overlaid by INI files, later ones first; sections are free, keys are the fields."""
        out = cls()
        kinds = {f.name: type(getattr(out, f.name)) for f in fields(cls)}
        for path in paths:
            parser = configparser.ConfigParser()
            with open(path) as f:
                parser.read_file(f)
            changed = {}
            for section in parser.sections():
                for key in parser[section]:
                    if key not in kinds:
                        raise ValueError(f"{path}: unknown parameter {key}")
                    changed[key] = parser[section].getboolean(key) if kinds[key] is bool else kinds[key](parser[section][key])
            out = replace(out, **changed)
        return out
