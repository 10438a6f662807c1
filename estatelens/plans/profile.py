"""The statistical profile of a scan.

A profile is one long frame ``(section, key1, key2, key3, value)``. The rows are read three
times: once into a lattice of partial counts, from which every count section is rolled up,
once for the values of properties, and once to meet their costs. One job computes all
sections, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import types as catalogue
from estatelens.catalogues import words
from estatelens.operators import (
    clusters, costs, findings, governance, histogram, lattice, names, pairs, shapes, tags, templates, topology,
)
from estatelens.operators.joins import scalar
from estatelens.operators.leaks import refuse_leaks
from estatelens.session import settle

SHAPE = ("section", "key1", "key2", "key3", "value")
OPTIONAL = (
    "type_cooccurrence", "tag_key_cooccurrence", "tag_value_cardinality", "untagged_rate_by_type",
    "naming_conventions", "cost_distributions",
)
NAMING = ("naming_patterns", "naming_positions")


class TermListRequired(RuntimeError):
    """A profile of real data needs a term list to be scanned against."""


class ProfileError(ValueError):
    """The profile breaks its schema."""


def _entries(df: DataFrame, section: str, value: Column | str, *keys: Column | str) -> DataFrame:
    padded = [*(F.col(k) if isinstance(k, str) else k for k in keys)]
    padded += [F.lit(None)] * (3 - len(padded))
    value = F.col(value) if isinstance(value, str) else value
    return df.select(
        F.lit(section).alias("section"),
        *[k.cast("string").alias(f"key{i + 1}") for i, k in enumerate(padded)],
        value.cast("double").alias("value"),
    )


def _melted(df: DataFrame, section: str, key: str, measures: list[str]) -> DataFrame:
    """One entry per measure column, NULLs left out."""
    pairs_ = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures])
    long = df.select(F.col(key).alias("k"), F.explode(pairs_).alias("p")).where(F.col("p.v").isNotNull())
    return _entries(long, section, F.col("p.v"), "k", F.col("p.m"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def archetype_entries(rows: DataFrame, min_size: int, k: int, locations: list[str]) -> DataFrame:
    """Owner archetypes from the lattice; ``locations`` are the values to spread over feature columns."""
    wide = histogram.pivot_counts(rows, "subscription_id", "location", locations, weight="n")
    features = tags.owner_features(rows, weight="n").join(wide, "subscription_id")
    columns = ["resource_count", "rg_count", "tag_density", *[f"loc__{v}" for v in sorted(locations)]]
    clustered = clusters.cluster_owners(features, "subscription_id", columns, k)
    found = max(1, min(k, clustered.count()))
    summary, where = clusters.archetypes(clustered, found, min_size, columns[3:])
    measures = [c for c in summary.columns if c not in ("cluster", "id")]
    return _melted(summary, "archetypes", "id", measures).unionByName(
        _entries(where, "archetype_locations", "share", "id", "location"))


def build_profile(
    scan: dict[str, DataFrame],
    min_size: int = words.MIN_BUCKET,
    terms: DataFrame | None = None,
    allow_no_terms: bool = False,
    k: int | None = None,
    locations: list[str] | None = None,
    property_fields: dict[str, tuple[str, ...]] = catalogue.PROPERTY_FIELDS,
    finding_codes: dict[str, str] = catalogue.VIOLATION_OF_FINDING,
) -> DataFrame:
    """Every section of the profile of a scan, as one long frame.

    ``scan`` has the five scan tables; empty optional ones are reported in the
    ``coverage`` section. Archetypes need ``k`` and the location values.
    """
    histogram.check_floor(min_size)
    if terms is None and not allow_no_terms:
        raise TermListRequired("give a term list, or allow profiling without one")
    rows = scan["resources"]
    base = lattice.row_lattice(rows)
    # Clustering is many short jobs over few rows, so it runs beside the other sections.
    beside = ThreadPoolExecutor(1)
    owners = None if k is None else beside.submit(
        inheritable_thread_target(rows.sparkSession)(archetype_entries), base, min_size, k, locations or [])
    # JSON texts are parsed once for each type that carries them.
    tagged = settle(lattice.rolled_up(base, "type", "tags"))
    total = scalar(tagged.agg(histogram.rows_of("n")))

    def counted(name: str, label: str) -> DataFrame:
        return _entries(scan[name].agg(F.count(F.lit(1)).alias("n")), "source_stats", "n", F.lit(label))

    frequencies = histogram.type_frequencies(lattice.rolled_up(tagged, "type"), min_size)
    shaped = shapes.type_shapes(rows, frequencies, min_size, property_fields)
    values = settle(tags.tag_value_counts(tagged, weight="n"))
    # A row carries a key once, so its values' counts add up to the key's.
    keys = values.groupBy("key").agg(F.sum("n").alias("n"))
    # The types of each group, read for the sets and, twice, for the pairs.
    grouped = settle(lattice.rolled_up(base, "subscription_id", "resource_group", "type"))
    sets = templates.group_type_sets(grouped, scan["resource_groups"], weight="n")
    standing, mass = templates.templates(sets, min_size)
    patterns, positions = names.sequence_shares(settle(lattice.rolled_up(base, "classes")), min_size)
    samples = costs.cost_samples(scan["resource_costs"], rows)
    by_template = standing.select("id", F.explode("type_set").alias("type"))
    sections = [
        counted("subscriptions", "total_subscriptions"),
        counted("resource_groups", "total_resource_groups"),
        _entries(tagged.agg(histogram.rows_of("n").alias("n")), "source_stats", "n", F.lit("total_resources")),
        _entries(frequencies, "resource_types", "share", "type"),
        _entries(shaped, "type_shapes", "share", F.concat_ws("|", "part", "type"), "field", "value"),
        _entries(tags.key_frequencies(keys, total), "tag_key_frequencies", "share", "key"),
        _entries(tags.value_shares(values, min_size), "tag_value_distributions", "share", "key", "value"),
        _entries(pairs.key_cooccurrence(pairs.key_pair_counts(tagged, "tags", min_size, weight="n"), min_size), "tag_key_cooccurrence", "share", "source", "target"),
        _entries(tags.value_cardinality(values, min_size), "tag_value_cardinality", "cardinality", "key"),
        _entries(tags.untagged_rates(tags.tag_coverage(tagged, weight="n")), "untagged_rate_by_type", "rate", "type"),
        _entries(
            pairs.cooccurrence(pairs.pair_counts(grouped, ["subscription_id", "resource_group"], "type", min_size), min_size),
            "type_cooccurrence", "share", "source", "target"),
        _entries(patterns, "naming_patterns", "share", "pattern"),
        _entries(positions, "naming_positions", "share", "position", "token_class"),
        _melted(standing, "templates", "id", ["weight", "mean", "std", "min", "max", "empty_share"]),
        _entries(by_template, "template_types", F.lit(1.0), "id", "type"),
        _entries(mass, "template_type_weights", "share", F.lit(words.MISC), "type"),
        _entries(
            histogram.location_shares(lattice.rolled_up(base, "location"), min_size),
            "location_distribution", "share", "location"),
        _entries(topology.topology_odds(topology.crossings(lattice.rolled_up(base, "subscription_id", "target").withColumnRenamed("subscription_id", "source"))), "topology", "value", "pattern", "measure"),
        _entries(
            findings.violation_rates(scan["findings"], total, min_size, governance.CODES, finding_codes),
            "violation_rates", "rate", "code"),
        _melted(costs.lognormal_fit(samples, "monthly_cost", min_size), "cost_distributions", "type", ["mu", "sigma", "sample_count"]),
    ]
    # A few thousand rows that the verdicts, checks, leak scan and writers all read again.
    profile = settle(_union(sections))
    if owners is not None:
        profile = profile.unionByName(settle(owners.result()))
    no_costs = scalar(scan["resource_costs"].limit(1).agg(F.count(F.lit(1)))) == 0
    return profile.unionByName(coverage(profile, no_costs))


def coverage(profile: DataFrame, no_costs: Column) -> DataFrame:
    """A verdict per optional section: derived, insufficient_coverage or no_source."""
    section = F.when(F.col("section").isin(*NAMING), "naming_conventions").otherwise(F.col("section"))
    # Distinct section names: a couple of dozen rows.
    seen = profile.select(section.alias("name")).distinct().withColumn("seen", F.lit(True))
    spark = profile.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in (*OPTIONAL, "api_version")])).alias("name"))
    verdict = (
        F.when(F.col("name") == "api_version", "no_source")
        .when((F.col("name") == "cost_distributions") & no_costs, "no_source")
        .when(F.col("seen"), "derived")
        .otherwise("insufficient_coverage")
    )
    return _entries(asked.join(seen, "name", "left"), "coverage", F.lit(1.0), "name", verdict)


# --- schema: which values a section may hold -----------------------------------------

SHARE_SECTIONS = (
    "resource_types", "type_shapes", "tag_key_frequencies", "tag_value_distributions",
    "tag_key_cooccurrence", "untagged_rate_by_type", "type_cooccurrence", "naming_patterns",
    "naming_positions", "template_types", "template_type_weights", "location_distribution",
    "violation_rates", "archetype_locations", "coverage",
)
OTHER_SECTIONS = (
    "source_stats", "tag_value_cardinality", "templates", "topology", "cost_distributions", "archetypes",
)
# Sections whose shares add up to 1 within the given keys.
WHOLES = {
    "resource_types": (), "naming_patterns": (), "location_distribution": (),
    "tag_value_distributions": ("key1",), "type_cooccurrence": ("key1",), "naming_positions": ("key1",),
    "type_shapes": ("key1", "key2"), "archetype_locations": ("key1",),
}


def broken_entries(profile: DataFrame) -> DataFrame:
    """Entries of unknown sections, shares outside [0, 1], and values that are no numbers."""
    known = F.col("section").isin(*SHARE_SECTIONS, *OTHER_SECTIONS)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    is_share = F.col("section").isin(*SHARE_SECTIONS)
    in_range = F.col("value").between(0.0, 1.0 + 1e-9)
    negative_ok = F.col("section") == "cost_distributions"
    fine = known & finite & F.when(is_share, in_range).otherwise(negative_ok | (F.col("value") >= 0))
    return profile.where(~F.coalesce(fine, F.lit(False)))


def check_profile(profile: DataFrame) -> None:
    bad = broken_entries(profile).select("section").take(1)
    if bad:
        raise ProfileError(f"section {bad[0][0]!r} holds a value it must not hold")


def profile_strings(profile: DataFrame) -> DataFrame:
    """(section, text) of every string a profile would publish."""
    texts = F.explode(F.array("key1", "key2", "key3"))
    return profile.select("section", texts.alias("text")).where(F.col("text").isNotNull()).distinct()


def refuse_leaking_profile(profile: DataFrame, terms: DataFrame) -> None:
    refuse_leaks(profile_strings(profile), terms, "section", "text")


# --- review ---------------------------------------------------------------------------

REVIEWED: dict[str, tuple[str, Callable[[], Column]]] = {
    "resource_types": ("resource_types", lambda: F.col("key1")),
    "tag_key_frequencies": ("tag_keys", lambda: F.col("key1")),
    "tag_value_distributions": ("tag_values", lambda: F.col("key2")),
    "archetypes": ("archetype_ids", lambda: F.col("key1")),
    "archetype_locations": ("locations", lambda: F.col("key2")),
    "templates": ("rg_template_ids", lambda: F.col("key1")),
    "violation_rates": ("governance_types", lambda: F.col("key1")),
    "naming_patterns": ("naming_patterns", lambda: F.col("key1")),
    "coverage": ("provenance_coverage", lambda: F.concat_ws(": ", "key1", "key2")),
    "source_stats": ("source_stats", lambda: F.concat_ws("=", F.col("key1"), F.col("value").cast("long"))),
}


def review(profile: DataFrame) -> DataFrame:
    """(category, text, strings): every distinct published string with its category's size."""
    category, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for section, (name, build) in REVIEWED.items():
        here = F.col("section") == section
        category = F.when(here, name).otherwise(category)
        text = F.when(here, build()).otherwise(text)
    strings = profile.select(category.alias("category"), text.alias("text")).where(
        F.col("category").isNotNull() & F.col("text").isNotNull()).distinct()
    sizes = strings.groupBy("category").agg(F.count(F.lit(1)).alias("strings"))
    return strings.join(sizes, "category").orderBy("category", "text")
