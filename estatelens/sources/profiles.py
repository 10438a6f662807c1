"""Profiles on disk: long rows, the nested JSON document, and the same document in lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.plans.profile import check_profile, refuse_leaking_profile

LONG = "section string, key1 string, key2 string, key3 string, value double"
MAX_DOCUMENT_ENTRIES = 200_000

STATS = "struct<mean: double, std: double, min: double, max: double>"
SHARES = "map<string,double>"
NESTED = f"map<string,{SHARES}>"
DOCUMENT = (
    "version string, extracted_at string, source_stats map<string,bigint>, "
    f"resource_type_distributions map<string,struct<frequency: double, property_distributions: {NESTED}, "
    f"sku_distributions: {NESTED}, kind_distributions: {SHARES}>>, "
    f"resource_group_templates array<struct<id: string, weight: double, type_set: array<string>, "
    f"resource_count: {STATS}, type_weights: {SHARES}, empty_share: double>>, "
    f"subscription_archetypes array<struct<id: string, weight: double, resource_group_count: {STATS}, "
    f"resource_count: {STATS}, location_distribution: {SHARES}, tag_density: struct<mean: double, std: double>>>, "
    f"tag_distributions struct<key_frequencies: {SHARES}, value_distributions: {NESTED}, "
    f"key_cooccurrence: {NESTED}, value_cardinality: map<string,bigint>, untagged_rate_by_type: {SHARES}>, "
    f"resource_type_cooccurrence {NESTED}, "
    f"naming_conventions struct<pattern_frequencies: {SHARES}, position_token_classes: {NESTED}>, "
    f"governance_violations struct<type_frequencies: {SHARES}>, "
    "cost_distributions map<string,struct<distribution: string, mu: double, sigma: double, "
    "shape: double, scale: double, sample_count: bigint>>"
)


class TooLarge(ValueError):
    """The profile has too many entries for one document; use the long form."""


def write_profile(profile: DataFrame, folder: str, terms: DataFrame | None = None) -> None:
    """Check, scan for leaks, then write the long form, one folder per section."""
    check_profile(profile)
    if terms is not None:
        refuse_leaking_profile(profile, terms)
    profile.write.mode("overwrite").partitionBy("section").json(folder)


def read_profile(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LONG).json(folder).select("section", "key1", "key2", "key3", "value")


def _shares(section: str, key: str = "key1") -> Column:
    hit = F.when(F.col("section") == section, F.struct(F.col(key), F.col("value")))
    return F.map_from_entries(F.collect_list(hit))


def _nested(profile: DataFrame, section: str, outer: str = "key1", inner: str = "key2") -> Column:
    rows = profile.where(F.col("section") == section).groupBy(outer).agg(
        F.map_from_entries(F.collect_list(F.struct(inner, "value"))).alias("m"))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(outer, "m")))).scalar()


def _type_map(profile: DataFrame) -> Column:
    """Types with their frequency and the value shares of their fields."""
    types = profile.where(F.col("section") == "resource_types").select(
        F.col("key1").alias("type"), F.col("value").alias("frequency"))
    shaped = profile.where(F.col("section") == "type_shapes").groupBy(
        F.split("key1", "\\|")[0].alias("part"), F.split("key1", "\\|")[1].alias("type"), F.col("key2").alias("field")
    ).agg(F.map_from_entries(F.collect_list(F.struct("key3", "value"))).alias("shares"))
    for part in ("properties", "sku"):
        fields = shaped.where(F.col("part") == part).groupBy("type").agg(
            F.map_from_entries(F.collect_list(F.struct("field", "shares"))).alias(part))
        types = types.join(fields, "type", "left")
    kinds = shaped.where(F.col("part") == "kind").select("type", F.col("shares").alias("kind"))
    entry = F.struct(
        "frequency", F.col("properties").alias("property_distributions"), F.col("sku").alias("sku_distributions"),
        F.col("kind").alias("kind_distributions"))
    return types.join(kinds, "type", "left").agg(F.map_from_entries(F.collect_list(F.struct(F.col("type"), entry)))).scalar()


def _measured(profile: DataFrame, section: str, measures: list[str]) -> DataFrame:
    return profile.where(F.col("section") == section).groupBy(F.col("key1").alias("id")).agg(
        *[F.max(F.when(F.col("key2") == m, F.col("value"))).alias(m) for m in measures])


def _archetype_rows(profile: DataFrame) -> DataFrame:
    stats = ("mean", "std", "min", "max")
    counts = [f"{c}_{m}" for c in ("rg_count", "resource_count") for m in stats]
    rows = _measured(profile, "archetypes", ["weight", "tag_density_mean", "tag_density_std", *counts])
    places = profile.where(F.col("section") == "archetype_locations").groupBy(F.col("key1").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("key2", "value"))).alias("location_distribution"))

    def of(c: str) -> Column:
        return F.struct(*[F.col(f"{c}_{m}").alias(m) for m in stats])

    entry = F.struct(
        "id", "weight", of("rg_count").alias("resource_group_count"), of("resource_count").alias("resource_count"),
        "location_distribution",
        F.struct(F.col("tag_density_mean").alias("mean"), F.col("tag_density_std").alias("std")).alias("tag_density"))
    return rows.join(places, "id", "left").select(entry.alias("entry"))


def _template_rows(profile: DataFrame) -> DataFrame:
    stats = _measured(profile, "templates", ["weight", "mean", "std", "min", "max", "empty_share"])
    types = profile.where(F.col("section") == "template_types").groupBy(F.col("key1").alias("id")).agg(
        F.sort_array(F.collect_list("key2")).alias("type_set"))
    weights = profile.where(F.col("section") == "template_type_weights").groupBy(F.col("key1").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("key2", "value"))).alias("type_weights"))
    entry = F.struct(
        "id", "weight", "type_set", F.struct("mean", "std", "min", "max").alias("resource_count"), "type_weights", "empty_share")
    return stats.join(types, "id", "left").join(weights, "id", "left").select(entry.alias("entry"))


def _cost_rows(profile: DataFrame) -> DataFrame:
    rows = _measured(profile, "cost_distributions", ["mu", "sigma", "shape", "scale", "sample_count"])
    family = F.when(F.col("shape").isNotNull(), "gamma").otherwise("lognormal")
    entry = F.struct(
        family.alias("distribution"), "mu", "sigma", "shape", "scale", F.col("sample_count").cast("bigint").alias("sample_count"))
    return rows.select("id", entry.alias("entry"))


# Where the document keeps a section of single values, and one of values by two keys.
SINGLE = {
    "source_stats": "source_stats", "tag_key_frequencies": "tag_distributions.key_frequencies",
    "tag_value_cardinality": "tag_distributions.value_cardinality",
    "untagged_rate_by_type": "tag_distributions.untagged_rate_by_type",
    "naming_patterns": "naming_conventions.pattern_frequencies", "violation_rates": "governance_violations.type_frequencies",
}
WHOLE_NUMBERS = ("source_stats", "tag_value_cardinality")
DOUBLE = {
    "tag_value_distributions": "tag_distributions.value_distributions", "tag_key_cooccurrence": "tag_distributions.key_cooccurrence",
    "type_cooccurrence": "resource_type_cooccurrence", "naming_positions": "naming_conventions.position_token_classes",
}
SHAPES = {"properties": "property_distributions", "sku": "sku_distributions"}


def _at(path: str, value: Column) -> Column:
    """JSON of a document that holds one value at ``path``."""
    for name in reversed(path.split(".")):
        value = F.struct(value.alias(name))
    return F.to_json(value)


def document_lines(profile: DataFrame, version: str = "1.2") -> DataFrame:
    """The document as JSON lines (``value``): each a document with one entry of one section.

    Together they say what the nested document says, and a profile of any size can be
    written so: only one template, archetype or cost fit is ever put together.
    """
    section, value = F.col("section"), F.col("value")
    types = "resource_type_distributions"
    lines = [F.when(section == "resource_types", _at(types, F.create_map("key1", F.struct(value.alias("frequency")))))]
    for name, path in SINGLE.items():
        held = value.cast("bigint") if name in WHOLE_NUMBERS else value
        lines.append(F.when(section == name, _at(path, F.create_map("key1", held))))
    for name, path in DOUBLE.items():
        lines.append(F.when(section == name, _at(path, F.create_map("key1", F.create_map("key2", value)))))
    part, type_ = F.split("key1", "\\|")[0], F.split("key1", "\\|")[1]
    for name, field in SHAPES.items():
        shares = F.create_map("key2", F.create_map("key3", value))
        lines.append(F.when((section == "type_shapes") & (part == name), _at(types, F.create_map(type_, F.struct(shares.alias(field))))))
    kinds = F.struct(F.create_map("key3", value).alias("kind_distributions"))
    lines.append(F.when((section == "type_shapes") & (part == "kind"), _at(types, F.create_map(type_, kinds))))
    head = profile.sparkSession.range(1).select(F.to_json(F.struct(
        F.lit(version).alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"))).alias("value"))
    parts = [
        profile.select(F.coalesce(*lines).alias("value")).where("value IS NOT NULL"),
        _template_rows(profile).select(_at("resource_group_templates", F.array("entry")).alias("value")),
        _archetype_rows(profile).select(_at("subscription_archetypes", F.array("entry")).alias("value")),
        _cost_rows(profile).select(_at("cost_distributions", F.create_map("id", "entry")).alias("value")),
    ]
    for lines_of_part in parts:
        head = head.unionByName(lines_of_part)
    return head


def profile_document(profile: DataFrame, version: str = "1.2") -> DataFrame:
    """One nested row with every section the document format knows.

    A document is one value, so it is only built below a checked number of entries; the
    long form and `document_lines` have no such bound.
    """
    n = profile.count()
    if n > MAX_DOCUMENT_ENTRIES:
        raise TooLarge(f"{n} entries do not fit one document; write its lines")
    flat = profile.agg(
        _shares("source_stats").alias("source_stats"),
        _shares("tag_key_frequencies").alias("key_frequencies"),
        _shares("tag_value_cardinality").alias("value_cardinality"),
        _shares("untagged_rate_by_type").alias("untagged_rate_by_type"),
        _shares("naming_patterns").alias("pattern_frequencies"),
        _shares("violation_rates").alias("type_frequencies"),
    )
    return flat.select(
        F.lit(version).alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"),
        F.transform_values("source_stats", lambda _, v: v.cast("bigint")).alias("source_stats"),
        _type_map(profile).alias("resource_type_distributions"),
        _template_rows(profile).agg(F.collect_list("entry")).scalar().alias("resource_group_templates"),
        _archetype_rows(profile).agg(F.collect_list("entry")).scalar().alias("subscription_archetypes"),
        F.struct(
            "key_frequencies", _nested(profile, "tag_value_distributions").alias("value_distributions"),
            _nested(profile, "tag_key_cooccurrence").alias("key_cooccurrence"),
            F.transform_values("value_cardinality", lambda _, v: v.cast("bigint")).alias("value_cardinality"),
            "untagged_rate_by_type",
        ).alias("tag_distributions"),
        _nested(profile, "type_cooccurrence").alias("resource_type_cooccurrence"),
        F.struct(
            "pattern_frequencies", _nested(profile, "naming_positions").alias("position_token_classes"),
        ).alias("naming_conventions"),
        F.struct("type_frequencies").alias("governance_violations"),
        _cost_rows(profile).agg(F.map_from_entries(F.collect_list(F.struct("id", "entry")))).scalar().alias("cost_distributions"),
    )


def read_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The long form of a profile document, nested or in lines, checked before it is used."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=not lines)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, section: str, value, *keys) -> DataFrame:
        padded = [*keys, *[none] * (3 - len(keys))]
        return df.select(
            F.lit(section).alias("section"),
            *[k.cast("string").alias(f"key{i + 1}") for i, k in enumerate(padded)],
            value.cast("double").alias("value")).where(F.col("value").isNotNull())

    def flat(column: str, section: str) -> DataFrame:
        return rows(doc.select(F.explode(column).alias("k", "v")), section, F.col("v"), F.col("k"))

    def nested(column: str, section: str) -> DataFrame:
        outer = doc.select(F.explode(column).alias("k", "m"))
        return rows(outer.select("k", F.explode("m").alias("k2", "v")), section, F.col("v"), F.col("k"), F.col("k2"))

    types = doc.select(F.explode("resource_type_distributions").alias("type", "t"))
    parts = [
        flat("source_stats", "source_stats"),
        rows(types, "resource_types", F.col("t.frequency"), F.col("type")),
        flat("tag_distributions.key_frequencies", "tag_key_frequencies"),
        nested("tag_distributions.value_distributions", "tag_value_distributions"),
        nested("tag_distributions.key_cooccurrence", "tag_key_cooccurrence"),
        flat("tag_distributions.value_cardinality", "tag_value_cardinality"),
        flat("tag_distributions.untagged_rate_by_type", "untagged_rate_by_type"),
        nested("resource_type_cooccurrence", "type_cooccurrence"),
        flat("naming_conventions.pattern_frequencies", "naming_patterns"),
        nested("naming_conventions.position_token_classes", "naming_positions"),
        flat("governance_violations.type_frequencies", "violation_rates"),
    ]
    for part, column in (("properties", "property_distributions"), ("sku", "sku_distributions")):
        fields = types.select("type", F.explode(f"t.{column}").alias("field", "m"))
        values = fields.select("type", "field", F.explode("m").alias("label", "v"))
        parts.append(rows(values, "type_shapes", F.col("v"), F.concat_ws("|", F.lit(part), "type"), F.col("field"), F.col("label")))
    kinds = types.select("type", F.explode("t.kind_distributions").alias("label", "v"))
    parts.append(rows(kinds, "type_shapes", F.col("v"), F.concat_ws("|", F.lit("kind"), "type"), F.lit("kind"), F.col("label")))

    t = doc.select(F.explode("resource_group_templates").alias("t"))
    a = doc.select(F.explode("subscription_archetypes").alias("t"))

    def measures(df: DataFrame, section: str, paths: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"t.{p}").cast("double").alias("v")) for m, p in paths.items()])
        return rows(df.select(F.col("t.id").alias("id"), F.explode(pairs).alias("p")), section, F.col("p.v"), F.col("id"), F.col("p.m"))

    parts.append(measures(t, "templates", {
        "weight": "weight", "empty_share": "empty_share", **{m: f"resource_count.{m}" for m in ("mean", "std", "min", "max")}}))
    parts.append(rows(t.select(F.col("t.id").alias("id"), F.explode("t.type_set").alias("type")), "template_types", F.lit(1.0), F.col("id"), F.col("type")))
    weighted = t.select(F.col("t.id").alias("id"), F.explode("t.type_weights").alias("type", "v"))
    parts.append(rows(weighted, "template_type_weights", F.col("v"), F.col("id"), F.col("type")))
    parts.append(measures(a, "archetypes", {
        "weight": "weight", "tag_density_mean": "tag_density.mean", "tag_density_std": "tag_density.std",
        **{f"rg_count_{m}": f"resource_group_count.{m}" for m in ("mean", "std", "min", "max")},
        **{f"resource_count_{m}": f"resource_count.{m}" for m in ("mean", "std", "min", "max")}}))
    where = a.select(F.col("t.id").alias("id"), F.explode("t.location_distribution").alias("location", "v"))
    parts.append(rows(where, "archetype_locations", F.col("v"), F.col("id"), F.col("location")))
    fits = doc.select(F.explode("cost_distributions").alias("id", "t"))
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"t.{m}").cast("double").alias("v")) for m in ("mu", "sigma", "shape", "scale", "sample_count")])
    parts.append(rows(fits.select("id", F.explode(pairs).alias("p")), "cost_distributions", F.col("p.v"), F.col("id"), F.col("p.m")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    check_profile(out)
    return out
