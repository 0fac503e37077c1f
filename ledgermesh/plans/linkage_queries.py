"""Registered record-linkage queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BLOCKERS
from ..functions.keys import normalised, tokenised
from ..functions.similarity import sql_jaro_winkler
from ..operators import blocking, cascade, decide, evaluate, features, frequency, model, profile, rules, validate
from ..sources.staging import materialize
from . import fixtures
from .oracle_sql import NATIVE, ORACLE_SQL

__all__ = ["BUILDERS", "ORACLE_SQL", "QUERIES", "Work"]
_SIX = 6


class Work:
    """The steps that a query's parts share. The keyed table is written once and read by each part."""

    def __init__(self, spark: SparkSession, sf_dir: str, phonetic: bool = False):
        self.spark, self.sf_dir, self.phonetic = spark, sf_dir, phonetic

    @property
    def entities(self) -> DataFrame:
        return fixtures.entities(self.spark, self.sf_dir)

    @property
    def truth(self) -> DataFrame:
        return fixtures.truth(self.spark, self.sf_dir)

    @property
    def tokens(self) -> DataFrame:
        return tokenised(normalised(self.entities))

    @property
    def norm(self) -> DataFrame:
        return normalised(self.entities).withColumn("hnum", F.lit(None).cast("string"))

    @cached_property
    def keyed(self) -> DataFrame:
        return materialize(blocking.keyed_records(self.entities, phonetic=self.phonetic), "keyed")

    def keys(self, *blockers: str) -> DataFrame:
        return blocking.long_keys(self.keyed, blockers or (list(BLOCKERS) if self.phonetic else NATIVE))

    @cached_property
    def lookup_pairs(self) -> DataFrame:
        return materialize(self.pairs, "candidates")

    @property
    def pairs(self) -> DataFrame:
        return blocking.candidates(self.keys())

    @property
    def reference(self) -> DataFrame:
        return self.norm.where("source = 1").select("entity_id", "country")

    @property
    def vendors(self) -> DataFrame:
        return self.norm.where("source <> 1").select("entity_id", "source", "country")

    @property
    def gt(self) -> DataFrame:
        return evaluate.truth_pairs(self.truth)

    @property
    def preds(self) -> DataFrame:
        """Pseudo-probabilities: the share of blockers that found a pair."""
        return self.pairs.select("s1_id", "cand_id", F.round(F.bit_count("mask") / 14.0, _SIX).alias("p"))

    @property
    def raw(self) -> DataFrame:
        return profile.prepared(self.entities)

    def side(self, reference: bool) -> DataFrame:
        return self.keyed.where("source = 1" if reference else "source <> 1")


def _joined(*columns: str):
    return [F.array_join(c, ";").alias(c) if c in ("k_compact", "k_rare2", "k_apair", "k_nameaddr", "k_numname") else F.col(c) for c in columns]


def _keys(*columns: str):
    return lambda w: w.keyed.select("entity_id", *_joined(*columns))


def _block(name: str):
    return lambda w: blocking.blocker_pairs(w.keys(name), name)


def _rule(name: str):
    return lambda w: rules.predict(w.pairs, name)


def _survivors(w: Work) -> DataFrame:
    out = cascade.survivors(w.preds, k=10, eps=0.1)
    rounded = ("p1", "gap", "ratio", "best_p", "second_p", "sum_p")
    return out.select("s1_id", "cand_id", "rk", "n_surv", "n_hi", "n_blocked", *(F.round(c, _SIX).alias(c) for c in rounded))


def _exact(w: Work) -> DataFrame:
    rows = features.exact_features(features.fetch(w.pairs, w.side(True), w.side(False)))
    rounded = ("core_jacc", "num_jacc")
    return rows.select("s1_id", "cand_id", *(F.round(c, _SIX).alias(c) if c in rounded else F.col(c).cast("double").alias(c) for c in features.EXACT))


def _context(w: Work) -> DataFrame:
    scores = ("blk_count", "core_jacc")  # the scores that SQL can compute, too
    out = features.context_features(_exact(w), scores=scores)
    whole = ("s1_ncand", *(f"{c}_rank" for c in scores))
    return out.select("s1_id", "cand_id", *(F.col(c).cast("long").alias(c) for c in whole), *(f"{c}_gap" for c in scores))


def _true_names(w: Work) -> DataFrame:
    side = lambda key, name: w.raw.select(F.col("entity_id").alias(key), F.col("name_n").alias(name))
    rows = w.gt.join(side("s1_id", "a"), "s1_id").join(side("cand_id", "b"), "cand_id")
    return rows.select("s1_id", "cand_id", F.round(sql_jaro_winkler("a", "b"), _SIX).alias("jw"))


def _faulty(w: Work) -> DataFrame:
    """An output with planted faults, for the validator to find."""
    found = blocking.grouped(w.reference, rules.predict(w.lookup_pairs, "R4"), "ids")
    end = F.right("source1_entity_id", F.lit(2))
    rows = found.where(end != "13").withColumn("ids", F.when(end == "77", "S1-5,S9-1,S2-999999999,S2-1,S2-1").otherwise(F.col("ids")))
    return rows.unionByName(w.spark.sql("SELECT 'S1-1' AS source1_entity_id, '' AS ids UNION ALL SELECT 'S1-none', 'S3-1'"))


def _validated(w: Work) -> DataFrame:
    return validate.findings(_faulty(w), "ids", w.reference, w.vendors, w.lookup_pairs.select("s1_id", "cand_id"))


def _learned(w: Work) -> tuple[DataFrame, list]:
    data = materialize(model.with_fold(evaluate.labelled(features.build_features(w.pairs, w.side(True), w.side(False)), w.gt)), "learned", by="fold")
    return model.out_of_fold(data, list(features.FEATURES), trees=5, depth=4)


def _siblings(w: Work) -> DataFrame:
    return cascade.with_siblings(cascade.survivors(w.preds, k=10, eps=0.1), w.norm.where("source <> 1"))


def _second_stage(w: Work) -> DataFrame:
    data = materialize(evaluate.labelled(_siblings(w), w.gt), "siblings")
    names = [*cascade.CONTEXT, *cascade.SIBLINGS]
    scored, models = model.out_of_fold(data, names, negative_share=1.0, trees=5, depth=3)
    mean = model.mean_of(models, data, names)
    return scored.withColumnRenamed("p", "p_oof").join(mean, ["s1_id", "cand_id"])


BUILDERS: dict[str, Callable[[Work], DataFrame]] = {
    "normalize_names": lambda w: normalised(w.entities),
    "name_tokens": lambda w: w.tokens.select("entity_id", F.array_join("tokens", " ").alias("tokens"), "compact", F.array_join("singulars", " ").alias("singulars"), F.array_join("dba", ";").alias("dba")),
    "parse_address": lambda w: w.tokens.select("entity_id", F.array_join("address_tokens", " ").alias("tokens"), "hnum", "postcode", "street", F.array_join("address_words", " ").alias("words")),
    "token_df": lambda w: frequency.name_frequencies(w.tokens),
    "addr_word_df": lambda w: frequency.address_frequencies(w.tokens),
    "keys_compact": _keys("k_compact"), "keys_sorted": _keys("k_sorted"), "keys_affix": _keys("k_pre", "k_suf"), "keys_rare": _keys("k_rare1", "k_rare2"), "keys_addr": _keys("k_addr", "k_addrname"),
    "keys_post": _keys("k_postname", "k_postrare"), "keys_apair": _keys("k_apair"), "keys_nameaddr": _keys("k_nameaddr"), "keys_numname": _keys("k_numname"),
    **{f"block_{b}": _block(b) for b in NATIVE},
    "block_stats": lambda w: blocking.block_stats(w.keys()),
    "candidates_mask": lambda w: w.pairs,
    "candidates_any_country": lambda w: blocking.candidates(blocking.long_keys(w.keyed, NATIVE, use_country=False)),
    "candidates_none": lambda w: evaluate.candidate_counts(w.pairs, w.reference).where("n = 0").select("entity_id", "country"),
    "keys_of_sample": lambda w: blocking.sampled(w.keyed, 0.15).select("entity_id", *_joined("k_compact")),
    "candidates_grouped": lambda w: blocking.grouped(w.reference, w.pairs),
    "gt_pairs": lambda w: w.gt,
    "ground_truth_facts": lambda w: evaluate.ground_truth_facts(w.gt, w.side(True), w.side(False)),
    "blocker_report": lambda w: evaluate.blocker_report(w.pairs, w.gt, w.reference),
    "union_report": lambda w: evaluate.union_report(w.lookup_pairs, w.gt, w.reference),
    "coverage": lambda w: evaluate.coverage(w.pairs, w.gt),
    "recall_by_source": lambda w: evaluate.recall_by_source(w.pairs, w.gt, w.vendors),
    "recall_by_country": lambda w: evaluate.recall_by_country(w.lookup_pairs, w.gt, w.reference),
    "missed_pairs": lambda w: evaluate.missed_pairs(w.pairs, w.gt, w.side(True), w.side(False)),
    "missed_categories": lambda w: evaluate.missed_categories(evaluate.missed_sample(evaluate.missed_pairs(w.pairs, w.gt, w.side(True), w.side(False)))),
    "trim_weights": lambda w: rules.trim_weights(w.pairs, w.gt),
    "trim_topk": lambda w: rules.top_k(rules.trim_scores(w.lookup_pairs, rules.trim_weights(w.lookup_pairs, w.gt)), 20).drop("source").withColumn("rk", F.col("rk").cast("long")),
    "trim_curve": lambda w: rules.trim_curve(rules.trim_scores(w.lookup_pairs, rules.trim_weights(w.lookup_pairs, w.gt)), w.gt, w.reference),
    **{f"rule_R{i}": _rule(f"R{i}") for i in range(1, 8)},
    "rule_one_owner": lambda w: rules.predict(w.pairs, "R4", one_owner=True),
    "rule_f05": lambda w: rules.rule_scores(w.lookup_pairs, w.gt, w.reference),
    "rule_f05_one_owner": lambda w: rules.rule_scores(w.lookup_pairs, w.gt, w.reference, one_owner=True),
    "decide_threshold": lambda w: decide.decide(w.preds, 0.5, 0.3),
    "decide_one_owner": lambda w: decide.decide(w.preds, 0.5, 0.3, one_owner=True),
    "decide_f05": lambda w: evaluate.score(decide.decide(w.preds, 0.5, 0.3, one_owner=True).select("s1_id", "cand_id"), w.gt, w.reference),
    "decide_grid": lambda w: decide.grid_scores(w.preds, w.gt, w.reference, decide.coarse_grid()),
    "decide_fine_grid": lambda w: decide.grid_scores(w.preds, w.gt, w.reference, decide.fine_grid(True, 0.3, 0.05)),
    "cascade_survivors": _survivors,
    "cascade_siblings": _siblings,
    "cascade_eval": lambda w: cascade.evaluate_grid(w.preds, w.gt, w.reference),
    "features_exact": _exact,
    "feature_context": _context,
    "features_all": lambda w: features.build_features(w.pairs, w.side(True), w.side(False)),
    "stage1_out_of_fold": lambda w: _learned(w)[0],
    "stage2_scores": _second_stage,
    "jaro_winkler": _true_names,
    "profile_files": lambda w: profile.file_profile(w.raw),
    "country_values": lambda w: profile.country_values(w.entities).withColumn("place", F.col("place").cast("long")),
    "truth_integrity": lambda w: profile.truth_integrity(w.truth, w.reference, w.vendors),
    "match_histogram": lambda w: profile.match_histogram(w.truth),
    "one_owner_check": lambda w: profile.owners(w.truth, w.vendors),
    "pair_difficulty": lambda w: profile.difficulty(w.truth, w.raw.where("source = 1"), w.raw.where("source <> 1")),
    "token_diff_top": lambda w: profile.one_sided_words(w.truth, w.raw.where("source = 1"), w.raw.where("source <> 1")),
    "example_pairs": lambda w: profile.example_pairs(w.truth, w.raw.where("source = 1"), w.raw.where("source <> 1")),
    "validate_matching": _validated,
    "validate_counts": lambda w: validate.row_counts(_faulty(w), "ids", w.reference, w.vendors, w.lookup_pairs),
}
_PHONETIC: dict[str, Callable[[Work], DataFrame]] = {"block_phonetic": _block("phonetic"), "candidates_all": lambda w: w.pairs}


def _query(build: Callable[[Work], DataFrame], phonetic: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Work(spark, sf_dir, phonetic))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(b, False) for n, b in BUILDERS.items()} | {n: _query(b, True) for n, b in _PHONETIC.items()}
