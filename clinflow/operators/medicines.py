"""Medicine lists: tiers, drug rows from labels, first-wins union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.text import strip
from clinflow.lookups.seeds import DEFAULT_OTC, DEFAULT_PRESCRIPTION
from clinflow.operators.containment import contained_pairs
from clinflow.operators.joining import first, lookup_join, top_rows


def tier_lists(drugs: DataFrame, order: str) -> DataFrame:
    """(disease, otc, rx): both lists of a drug table in `order`, each name once.

    Repeats are merged before the shuffle, so a list is as long as the disease has distinct drugs.
    """
    drugs = drugs.groupBy("disease", "drug_name", "drug_type").agg(F.min(order).alias(order))

    def names(kind: str) -> Column:
        row = F.when(F.col("drug_type") == kind, F.struct(F.col(order).alias("at"), F.col("drug_name").alias("name")))
        return F.transform(F.array_sort(F.collect_list(row)), lambda r: r["name"])

    lists = drugs.groupBy("disease").agg(names("otc").alias("otc"), names("prescription").alias("rx"))
    return lists.filter((F.size("otc") > 0) | (F.size("rx") > 0))


def suggest_medicines(requests: DataFrame, tiers: list[tuple[str, DataFrame]], last_name: str = "static") -> DataFrame:
    """Adds otc, prescription, recommended and source to rows of (disease, medicine_type, …).

    The whole entry of the first tier that knows the disease wins. `tiers` are (name, lists) with
    lists from `tier_lists`.
    """
    ranked = reduce(DataFrame.unionByName, [
        lists.select("disease", "otc", "rx", F.lit(name).alias("source"), F.lit(at).alias("tier"))
        for at, (name, lists) in enumerate(tiers)
    ])
    chosen = first(ranked, ["disease"], F.col("tier")).select("disease", F.struct("otc", "rx", "source").alias("_m"))
    default = F.struct(
        F.lit(DEFAULT_OTC).alias("otc"), F.lit(DEFAULT_PRESCRIPTION).alias("rx"), F.lit(last_name).alias("source")
    )
    joined = lookup_join(requests, chosen, ["disease"])
    entry_or_default = F.coalesce("_m", default)
    return joined.withColumn("_m", entry_or_default).select(
        *requests.columns, F.col("_m.otc").alias("otc"), F.col("_m.rx").alias("prescription"),
        F.when(F.col("medicine_type") == "otc", F.col("_m.otc")).otherwise(F.col("_m.rx")).alias("recommended"),
        F.col("_m.source").alias("source"),
    )


def label_names(labels: DataFrame, names_per_label: int | None = None) -> DataFrame:
    """Adds `names` (sorted, distinct; the first `names_per_label`, by default all) and `description` to drug labels.

    `labels` has openfda struct arrays brand_name, generic_name and substance_name, and
    indications_and_usage.
    """
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.col(f"openfda.{name}"), none) for name in ("brand_name", "generic_name", "substance_name")]
    names = F.array_sort(F.array_distinct(F.transform(F.concat(*parts), lambda n: F.initcap(strip(n)))))
    indication = F.coalesce(F.get("indications_and_usage", F.lit(0)), F.lit(""))
    kept = names if names_per_label is None else F.slice(names, 1, names_per_label)
    return labels.withColumn("names", kept).withColumn(
        "description", F.substring(indication, 1, 200)
    ).withColumn("indication", indication)


def label_drugs(labels: DataFrame, terms: DataFrame, order: str, terms_per_disease: int | None = None,
                labels_per_term: int | None = None) -> DataFrame:
    """Drug rows of labels whose indication contains a search term of a disease.

    `labels` comes from `label_names`; `terms` has (disease, term, pos). All terms of a disease and
    all labels of a term by default; `terms_per_disease` and `labels_per_term` (by `order`) keep the first ones.
    """
    few = terms if terms_per_disease is None else terms.filter(F.col("pos") < terms_per_disease)
    used = few.withColumn("_term", F.lower("term"))
    texts = labels.select(F.col(order).alias("_label"), F.lower("indication").alias("_text"))
    pairs = contained_pairs(texts, used.select("_term"), "_text", "_term", ["_label"])
    # A common term may sit in most labels: its first labels are limited before the shuffle.
    kept = pairs if labels_per_term is None else top_rows(pairs, ["_term"], [F.asc("_label")], labels_per_term)
    chosen = kept.join(used, "_term").join(
        labels.select(F.col(order).alias("_label"), "names", "description"), "_label"
    )
    return chosen.select(
        "disease", F.posexplode("names").alias("name_pos", "drug_name"), F.lit("prescription").alias("drug_type"),
        "description", F.col("pos").alias("term_pos"), F.col("_label").alias("label_pos"),
    )


def first_wins(tiers: list[tuple[int, DataFrame]]) -> DataFrame:
    """First row per (disease, drug_name) over tables of rising tier and `pos`."""
    rows = reduce(DataFrame.unionByName, [table.withColumn("tier", F.lit(tier)) for tier, table in tiers])
    return first(rows, ["disease", "drug_name"], F.struct("tier", "pos"))


def new_drugs(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """K2: entries whose (disease, drug_name) is not stored yet."""
    return entries.join(existing.select("disease", "drug_name"), ["disease", "drug_name"], "left_anti")
