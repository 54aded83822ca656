"""Queries of the feature catalogue and of the rules over it, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from docsift.functions import features, rules
from docsift.functions.dialect import DuckDB, Spark
from docsift.plans.profiles import candidates, duckdb_sql, profiles, with_features, with_typos

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_ALONE = [g for g in features.GROUPS if g not in ("g10_penalties", "g11_composite")]


def _register(name: str, columns: list[str], groups=tuple(features.GROUPS), extra=lambda d: []) -> None:
    """extra makes the layers on top of the features for an engine."""

    def run(spark, sf_dir):
        made = profiles(candidates(spark, sf_dir))
        out = with_features(with_typos(made) if typos else made, groups)
        for layer in extra(Spark()):
            out = out.selectExpr("*", *[f"{v} AS {k}" for k, v in layer.items()])
        return out.select("doc_id", *columns)

    typos = bool(extra(Spark()))
    QUERIES[name], ORACLES[name] = run, duckdb_sql(columns, groups, extra(DuckDB()), typos)


for _g in features.GROUPS:
    _register(_g, features.names(_g), (_g,) if _g in _ALONE else tuple(features.GROUPS))
_ATS = ["contact_score", "structure_score", "content_score", "length_score", "typo_score", "ats_score", "reasons"]
#: What a reader may have left of two numbers.
_READ = {"grade_read": "CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE CAST(grade_score AS STRING) END", "words_read": "CASE WHEN doc_id % 10 = 7 THEN '' ELSE CAST(n_words AS STRING) END"}
_register("qs5_ats_score", _ATS, extra=rules.ats)
_register("qs7_qs8_candidate_score", ["candidate_score", "reject_reasons", "passes_rules"], extra=lambda d: rules.CANDIDATE)
_register("qs13_model_record", list(rules.MODEL_INPUTS), extra=lambda d: [rules.RECORD])
_register("qs6_safe_score", [f"safe_{c}" for c in _ATS], extra=lambda d: [*rules.ats(d), _READ, rules.safe(_ATS, ("grade_read", "words_read"))])
_register("qs9_feature_validation", ["is_valid", "passes_rules"], extra=lambda d: [rules.RECORD, {"listed": f"CASE WHEN doc_id % 4 = 0 THEN {d.take('skills', 1)} ELSE skills END"}, rules.validation(d, "listed")])
_register("qs15_labels", ["label", "label_strict"], extra=lambda d: [rules.RECORD, {"label": rules.label(), "label_strict": rules.label({**rules.LABELS, "allow_fresher": False})}])
_register("qs16_hard_rules", ["reasons"], extra=lambda d: [{"reasons": rules.hard_rules(1, ("ai_ml", "web_dev"))}])
