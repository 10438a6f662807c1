"""Do texts leak identifiers from a term list?

A term leaks where it stands in a text as a whole token: no letter, digit or underscore
directly before or after it. Terms may contain separators. Matching is case-sensitive.
The result carries lengths, never the terms.

Every run of identifier characters inside a leaked term is a whole token of the text, so
texts and terms meet by an equality join on one token per term, the rarest one in the
texts. Terms of one single token need nothing further; the others are verified in the
candidate texts. Terms without any identifier character meet texts through the short
separator runs. The term list is a frame of any size; nothing is compiled from it.

Texts are met by their distinct tokens, hot ones spread by a salt. Sides that grow with the
texts or the term list are merged, never sent whole through the driver: the planner sees
neither the repeats of the salt nor how long the texts are once they are unpacked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions.jsonmaps import json_map
from estatelens.functions.text import is_identifier_term, is_listed
from estatelens.session import settle
from . import bloom
from .joins import join_salted

IDENT = "[\\p{L}\\p{N}_]"
IDENT_RUN = IDENT + "+"
OTHER_RUN = "[^\\p{L}\\p{N}_]+"
EDGE = "\u0000"


def _runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _stands_in(text: Column, term: Column) -> Column:
    """Whole-token occurrence of ``term`` anywhere in ``text``."""
    quoted = F.concat(
        F.lit(f"(?<!{IDENT})\\Q"),
        F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit(f"\\E(?!{IDENT})"),
    )
    return F.contains(text, term) & F.rlike(text, quoted)


def _terms(terms: DataFrame, term: str) -> DataFrame:
    return terms.select(F.col(term).alias("term")).where(
        F.col("term").isNotNull() & (F.trim("term") != "")
    ).distinct()


def _held_tokens(rows: DataFrame, exploded: DataFrame) -> DataFrame:
    """Distinct (key, token) of the texts, but for tokens that a Bloom filter knows to be in no term.

    They are dropped where the text is split, before anything is written or moved; of the
    others about one in 200 passes.
    """
    bits = bloom.bits_for(exploded.count())
    words = bloom.build(exploded, "token", bits)
    found = F.explode(F.array_distinct(_runs(F.col("text"), IDENT_RUN))).alias("token")
    return rows.select("key", found).where(bloom.might_hold(F.col("token"), words, bits))


def leak_pairs(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term") -> DataFrame:
    """Distinct (key, term) of every leaked term."""
    # Read several times below.
    wanted = settle(
        _terms(terms, term).withColumn("parts", F.array_distinct(_runs(F.col("term"), IDENT_RUN)))
    )
    worded = wanted.where(F.size("parts") > 0)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    exploded = worded.select("term", F.explode("parts").alias("token"))
    tokens = settle(_held_tokens(rows, exploded))
    # How many texts hold each token; the few that no term has do no harm.
    spread = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))
    # The rarest token of a term decides in which texts it can stand; a token that is in
    # no text rules the term out.
    anchored = (
        exploded.join(spread.hint("merge"), "token", "left")
        .groupBy("term")
        .agg(
            F.min_by("token", F.struct(F.coalesce("texts", F.lit(0)), F.length("token") * -1, "token")).alias("token"),
            F.min(F.coalesce("texts", F.lit(0))).alias("texts"),
        )
        .where(F.col("texts") > 0)
        .select("term", "token")
    )
    alone = F.col("term") == F.col("token")
    met = join_salted(tokens, anchored, "token", ["key"])
    longer = met.where(~alone).select("key", "term").join(rows.hint("merge"), "key")
    worded_hits = met.where(alone).select("key", "term").unionByName(
        longer.where(_stands_in(F.col("text"), F.col("term"))).select("key", "term")).distinct()

    bare = wanted.where(F.size("parts") == 0).select("term")
    if bare.isEmpty():
        return worded_hits
    longest = bare.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).scalar()
    edged = F.concat(F.lit(EDGE), F.col("text"), F.lit(EDGE))
    gaps = rows.select("key", F.explode(F.array_distinct(_runs(edged, OTHER_RUN))).alias("gap"))
    # A term inside a gap must leave one separator on either side, or reach the text's end.
    pieces = (
        gaps.where(F.length("gap") > 2)
        .withColumn("longest", longest)
        .where(F.col("longest") > 0)
        .select("key", "gap", "longest", F.explode(F.sequence(F.lit(2), F.length("gap") - 1)).alias("start"))
        .select(
            "key", "gap", "start",
            F.explode(
                F.sequence(F.lit(1), F.least(F.col("longest"), F.length("gap") - F.col("start")))
            ).alias("size"),
        )
        .select("key", F.substring(F.col("gap"), F.col("start"), F.col("size")).alias("term"))
        .distinct()
    )
    separators = join_salted(pieces, bare, "term", ["key"]).select("key", "term")
    return worded_hits.unionByName(separators).distinct()


def leaks(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term") -> DataFrame:
    """Leaked terms per text as (key, leaks, longest): how many, and the longest's length."""
    return (
        leak_pairs(texts, terms, key, text, term)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("leaks"), F.max(F.length("term")).alias("longest"))
        .withColumnRenamed("key", key)
    )


class LeakError(ValueError):
    """An identifier would leave with the output."""


def refuse_leaks(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term") -> None:
    """Raise if any text leaks; the message gives the length only."""
    worst = leaks(texts, terms, key, text, term).agg(F.max("longest")).first()[0]
    if worst is not None:
        raise LeakError(f"an identifier from the term list leaked (length {worst})")


def keep_term(term: Column) -> Column:
    """Long enough, no boolean word, not only digits."""
    trimmed = F.trim(term)
    return (
        (F.char_length(trimmed) >= words.MIN_TERM_LENGTH)
        & ~F.lower(trimmed).isin(*words.BOOLEAN_WORDS)
        & ~trimmed.rlike("^\\p{Nd}+$")
    )


def build_terms(
    columns: list[tuple[DataFrame, str]],
    tag_columns: list[tuple[DataFrame, str]] = (),
    reference: tuple[DataFrame, str, str] | None = None,
) -> DataFrame:
    """Terms from id and name columns, and from identifier-shaped tag values.

    ``reference`` (frame, key, text) is a known clean corpus: a term that stands in it
    is ordinary vocabulary and is dropped.
    """
    found = None
    for df, c in columns:
        part = df.select(F.col(c).cast("string").alias("term"))
        found = part if found is None else found.union(part)
    for df, c in tag_columns:
        values = df.where(F.col(c).isNotNull()).select(F.explode(F.map_values(json_map(c))).alias("term"))
        found = found.union(values.where(is_identifier_term("term")))
    kept = found.where(keep_term(F.col("term"))).select(F.trim("term").alias("term")).distinct()
    if reference is None:
        return kept
    clean, key, text = reference
    ordinary = leak_pairs(clean, kept, key, text).select("term").distinct()
    return kept.join(ordinary.hint("merge"), "term", "left_anti")


def row_terms(
    rows: DataFrame, scalars: list[str], tags: str, generic=words.GENERIC_TAG_KEYS,
    publishable=words.VALUE_TAG_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Identifier terms and published terms of raw rows.

    Scalars are identifiers. A tag under a key that is not generic gives its key and its
    value; a generic key is published, and its value is published where the key allows
    that and an identifier elsewhere.
    """
    known, open_values = is_listed("k", generic), is_listed("k", publishable)
    scalar_terms = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in scalars])).alias("term"))
    pairs = rows.where(F.col(tags).isNotNull()).select(F.explode(json_map(tags)).alias("k", "v"))
    pairs = pairs.groupBy("k", F.coalesce("v", F.lit("None")).alias("v")).agg(F.lit(1).alias("one"))
    placed = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("k").alias("term"), known.alias("published")),
                F.struct(F.col("v").alias("term"), (known & open_values).alias("published")),
            )
        )
    )
    blank = F.trim("term") == ""
    identifiers = scalar_terms.union(placed.where(~F.col("published")).select("term"))
    published = placed.where(F.col("published")).select("term")
    return (
        identifiers.where(F.col("term").isNotNull() & ~blank).distinct(),
        published.where(F.col("term").isNotNull() & ~blank).distinct(),
    )


def term_list(listed: DataFrame, derived: DataFrame, groups: DataFrame, published: DataFrame) -> DataFrame:
    """(listed + derived + group names) without what is published on purpose."""
    every = listed.select("term").union(derived.select("term")).union(groups.select("term"))
    return every.distinct().join(published.select("term").distinct(), "term", "left_anti")
