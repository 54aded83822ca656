"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import mixing, url_filter, warc
from .decontaminate import op3_benchmark_decontamination
from .gif import op2_gif_media
from .language import op5_language_id
from .minhash import op11_minhash_near_dedup
from .periodic_runs import op12_periodic_runs
from .quality import op7_quality_classifier
from .simhash import op10_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op6_suffix_array_dedup
from .whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_gif_media,
        op3_benchmark_decontamination,
        warc.op4_warc,
        op5_language_id,
        op6_suffix_array_dedup,
        op7_quality_classifier,
        mixing.op8_mixing,
        url_filter.op9_url_filters,
        op10_simhash_near_dedup,
        op11_minhash_near_dedup,
        op12_periodic_runs,
        op13_whitening,
    )
}

ORACLES = {"op4_warc": warc.ORACLE, "op8_mixing": mixing.ORACLE, "op9_url_filters": url_filter.ORACLE}
