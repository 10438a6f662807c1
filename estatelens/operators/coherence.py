"""Do a group's contents back the shape its name claims?

The catalogue is a short fixed list, so every score is an array expression on the row
itself: matching needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.catalogues import archetypes as catalogue
from estatelens.catalogues import words
from estatelens.catalogues.archetypes import ARCHETYPES, GENERIC_TOKENS, Archetype
from estatelens.functions.text import with_ancestor_types

# --- fixed values: must equal the reference's for right results ---------------------
MAX_CROSS_PERCENT = 1.0
MIN_GROUPS_AUDITED = 1
MIN_ROLE_GROUPS_AUDITED = 1
EXAMPLES = 5
CROSS_EXAMPLES = 3
EXAMPLE_TYPES = 6


class Evidence:
    """Columns that say which catalogue types a group holds.

    The type list is normalised once and every catalogue type is looked up once; scores
    are then sums of booleans.
    """

    def __init__(self, entries: tuple[Archetype, ...]):
        self.entries = entries
        every = [t for e in entries for t in e.anchors + e.supporting + e.generic + e.negative]
        self.types = sorted({t.lower() for t in every + list(catalogue.UBIQUITOUS_TYPES)})

    def add(self, df: DataFrame, types: str) -> DataFrame:
        present = F.filter(F.col(types), lambda t: t.isNotNull() & (t != ""))
        plain = F.array_distinct(F.transform(present, F.lower))
        rows = df.withColumn("__plain", plain)
        rows = rows.withColumn("__credited", with_ancestor_types("__plain"))
        checks = ["*", "coalesce(size(__plain) <= 0, true) AS __empty",
                  f"coalesce(array_contains(__plain, '{words.MISC}'), false) AS __folded"]
        for i, t in enumerate(self.types):
            checks.append(f"coalesce(array_contains(__credited, '{t}'), false) AS __held{i}")
            checks.append(f"coalesce(array_contains(__plain, '{t}'), false) AS __own{i}")
        return rows.selectExpr(*checks)

    def drop(self, df: DataFrame) -> DataFrame:
        helpers = [c for c in df.columns if c.startswith(("__held", "__own"))]
        return df.drop("__plain", "__credited", "__empty", "__folded", *helpers)

    def _columns(self, wanted, credited: bool) -> list[str]:
        prefix = "__held" if credited else "__own"
        return [f"{prefix}{self.types.index(t)}" for t in sorted({t.lower() for t in wanted})]

    def hits(self, wanted, credited: bool = True) -> Column:
        return F.expr(" + ".join(["0", *[f"int({c})" for c in self._columns(wanted, credited)]]))

    def any_of(self, wanted, credited: bool = True) -> Column:
        return F.expr(" OR ".join(["false", *self._columns(wanted, credited)]))


def _looks_like(evidence: Evidence) -> Column:
    """The shape with the best score, if its lead is clear."""
    nowhere = F.lit(float("-inf"))
    scores = {
        e.token: F.when(
            evidence.any_of(e.anchors),
            F.lit(catalogue.ANCHOR_WEIGHT)
            + catalogue.STRONG_WEIGHT * evidence.hits(e.supporting + e.generic)
            - catalogue.NEGATIVE_WEIGHT * evidence.hits(e.negative),
        ).otherwise(nowhere)
        for e in evidence.entries
    }
    ordered = F.sort_array(
        F.array(*[F.struct(s.alias("score"), F.lit(token).alias("token")) for token, s in scores.items()]),
        asc=False,
    )
    best = F.element_at(ordered, 1)
    second = F.get(ordered, F.lit(1))["score"]
    clear = (best["score"] >= catalogue.MIN_SCORE) & (
        best["score"] - F.coalesce(second, nowhere) >= catalogue.MIN_LEAD
    )
    anchored = evidence.any_of([t for e in evidence.entries for t in e.anchors])
    return (
        F.when(F.col("__empty") | F.col("__folded") | ~anchored, "shared")
        .when(clear, best["token"])
        .otherwise("core")
    )


def _confirms(evidence: Evidence, entry: Archetype, credited: bool) -> Column:
    anchored = evidence.any_of(entry.anchors, credited)
    if not entry.signals_confirm:
        return anchored
    own = evidence.hits(entry.supporting, credited)
    others = [evidence.hits(e.supporting, credited) for e in evidence.entries if e is not entry]
    rival = F.greatest(F.lit(0), *others) if others else F.lit(0)
    return anchored | (
        (own >= catalogue.MIN_SUPPORTING) & (own - rival >= catalogue.MIN_SUPPORTING_LEAD)
    )


def _per_token(token: Column, entries, value, default) -> Column:
    """The value belonging to the entry a token names."""
    out = F.when(token == entries[0].token, value(entries[0]))
    for e in entries[1:]:
        out = out.when(token == e.token, value(e))
    return out.otherwise(default)


def _confirmation(evidence: Evidence, token: Column) -> Column:
    entries = evidence.entries
    known = token.isin(*[e.token for e in entries])
    backed = _per_token(token, entries, lambda e: _confirms(evidence, e, True), F.lit(False))
    plainly = _per_token(token, entries, lambda e: _confirms(evidence, e, False), F.lit(False))
    passes = token.isin(*GENERIC_TOKENS) | ~known
    kept = (
        F.when(passes, token).when(F.col("__empty"), "shared").when(backed, token).otherwise("core")
    )
    confirmed = ~passes & ~F.col("__empty") & backed
    return F.struct(
        kept.alias("token"), confirmed.alias("confirmed"), (confirmed & ~plainly).alias("by_ancestors")
    )


def match_archetype(
    df: DataFrame, types: str, out: str, entries: tuple[Archetype, ...] = ARCHETYPES
) -> DataFrame:
    """Add the shape that a set of types looks like.

    ``shared`` without any anchor, ``core`` where no shape leads clearly. Nested types
    count for their ancestors too.
    """
    evidence = Evidence(entries)
    return evidence.drop(evidence.add(df, types).withColumn(out, _looks_like(evidence)))


def confirm_archetype(
    df: DataFrame, token: str, types: str, out: str, entries: tuple[Archetype, ...] = ARCHETYPES
) -> DataFrame:
    """Add a struct (token, confirmed, by_ancestors) for a claim and the actual contents.

    A claim without proof falls back to ``core``, or ``shared`` for an empty group;
    generic and unknown tokens pass through. ``by_ancestors`` marks claims that only the
    ancestors of nested types prove.
    """
    evidence = Evidence(entries)
    rows = evidence.add(df, types).withColumn(out, _confirmation(evidence, F.col(token)))
    return evidence.drop(rows)


def _judged(groups: DataFrame, token: str, types: str, entries: tuple[Archetype, ...], *keep: str) -> tuple[DataFrame, dict[str, Column]]:
    """One row per row of ``groups`` with its verdicts, and the conditions that are counted."""
    evidence = Evidence(entries)
    everywhere = {t.lower() for t in catalogue.UBIQUITOUS_TYPES}

    def only_common(e: Archetype) -> Column:
        """Anchored by ubiquitous types alone, one of them not declared as its own."""
        owned = {t.lower() for t in e.owned_ubiquitous}
        rare = [t for t in e.anchors if t.lower() not in everywhere]
        foreign = [t for t in e.anchors if t.lower() in everywhere - owned]
        return evidence.any_of(foreign) & ~evidence.any_of(rare)

    claim = F.col("token")
    rows = evidence.add(groups.withColumn("token", F.col(token)), types).select(
        "token",
        *keep,
        "__empty",
        _looks_like(evidence).alias("__looks"),
        _confirmation(evidence, claim)["token"].alias("__kept"),
        claim.isin(*[e.token for e in entries]).alias("__known"),
        claim.isin(*GENERIC_TOKENS).alias("__generic"),
        _per_token(claim, entries, lambda e: evidence.any_of(e.anchors), F.lit(False)).alias("__anchored"),
        _per_token(claim, entries, lambda e: F.lit(e.needs_anchor), F.lit(False)).alias("__needs"),
        _per_token(claim, entries, lambda e: F.lit(not e.signals_confirm), F.lit(False)).alias("__role"),
        _per_token(claim, entries, only_common, F.lit(False)).alias("__undeclared"),
    )
    full = ~F.col("__empty")
    claims = full & ~F.col("__generic")
    looks_generic = F.col("__looks").isin(*GENERIC_TOKENS)
    same = F.col("__looks") == F.col("token")
    known_claim = claims & F.col("__known")
    anchored, needs = F.col("__anchored"), F.col("__needs")
    return rows, {
        "empty": F.col("__empty"),
        "nonempty": full,
        "contents_semantic": full & F.col("__generic") & ~looks_generic,
        "unconfirmed": claims & (F.col("__kept") != F.col("token")),
        "unknown_token": claims & ~F.col("__known"),
        "with_anchor": known_claim & anchored,
        "anchorless": known_claim & ~anchored,
        "anchorless_needed": known_claim & ~anchored & needs,
        "needing_anchor": known_claim & needs,
        "role_groups": known_claim & F.col("__role"),
        "undeclared_ubiquitous": known_claim & F.col("__undeclared"),
        "agree": claims & same,
        "thin": claims & ~same & looks_generic,
        "cross": claims & ~same & ~looks_generic,
    }


def audit(
    groups: DataFrame, token: str = "token", types: str = "type_set",
    entries: tuple[Archetype, ...] = ARCHETYPES,
) -> DataFrame:
    """Per claimed token: how many groups, and how their contents compare with the claim.

    Groups with the same claim and the same types are judged once.
    """
    alike = groups.groupBy(F.col(token).alias("__token"), F.col(types).alias("__types")).agg(F.count(F.lit(1)).alias("__n"))
    rows, measures = _judged(alike, "__token", "__types", entries, "__n")
    return rows.groupBy("token").agg(*[
        F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0)).alias(name) for name, c in measures.items()])


def audit_examples(
    groups: DataFrame, token: str = "token", types: str = "type_set", name: str = "resource_group",
    entries: tuple[Archetype, ...] = ARCHETYPES, limit: int = EXAMPLES, cross_limit: int = CROSS_EXAMPLES,
) -> DataFrame:
    """(kind, token, name, instead, types): the first groups by name of each kind of fault.

    Empty groups under a claim, unconfirmed and undeclared ones: ``limit`` in all; groups
    without their anchor: ``limit`` per token; contents of another shape: ``cross_limit``
    per token. ``instead`` is the token that the contents back or look like, ``types`` the
    first few types. Only the first rows of each task reach the shuffle.
    """
    rows, measures = _judged(groups, token, types, entries, name, types)
    claim_over_nothing = F.col("__empty") & ~F.col("__generic") & (F.col("token") != "?")
    none = F.lit(None).cast("string")
    kinds = [
        ("empty", claim_over_nothing, none, False), ("unconfirmed", measures["unconfirmed"], F.col("__kept"), False),
        ("anchorless", measures["anchorless"], none, True), ("cross", measures["cross"], F.col("__looks"), True),
        ("undeclared", measures["undeclared_ubiquitous"], none, False)]
    marks = F.array(*[
        F.when(c, F.struct(
            F.lit(kind).alias("kind"), instead.alias("instead"),
            (F.col("token") if per_token else F.lit("")).alias("__scope")))
        for kind, c, instead, per_token in kinds])
    found = rows.select(
        "token", F.col(name).alias("name"), F.slice(F.sort_array(F.array_distinct(types)), 1, EXAMPLE_TYPES).alias("types"),
        F.inline(F.filter(marks, lambda m: m.isNotNull())))
    place = F.row_number().over(Window.partitionBy("kind", "__scope").orderBy("name", "token"))
    allowed = F.when(F.col("kind") == "cross", cross_limit).otherwise(limit)
    return (
        found.withColumn("__i", place)
        .where((F.col("__i") <= max(limit, cross_limit)) & (F.col("__i") <= allowed))
        .select("kind", "token", "name", "instead", "types"))


def examples(
    groups: DataFrame, token: str = "token", types: str = "type_set", name: str = "resource_group",
    entries: tuple[Archetype, ...] = ARCHETYPES, limit: int = EXAMPLES,
) -> DataFrame:
    """The first ``limit`` groups by name whose contents do not back their claim."""
    rows = groups.where((F.size(types) > 0) & ~F.col(token).isin(*GENERIC_TOKENS))
    judged = confirm_archetype(rows, token, types, "__v", entries)
    return (
        judged.select(F.col(token).alias("token"), F.col("__v.token").alias("kept"), F.col(name).alias("name"))
        .where(F.col("kept") != F.col("token"))
        .orderBy("name", "token")
        .limit(limit)
    )


def audit_metrics(audited: DataFrame) -> DataFrame:
    """The one-row evidence that the gates read."""
    semantic = ~F.col("token").isin(*GENERIC_TOKENS) & (F.col("token") != "?")

    def total(name: str, condition: Column = semantic) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0))

    audited_groups = total("nonempty")
    return audited.agg(
        audited_groups.alias("semantic_groups"),
        total("role_groups").alias("role_groups"),
        total("unconfirmed", F.lit(True)).alias("unconfirmed"),
        total("empty").alias("empty_semantic"),
        total("anchorless_needed").alias("anchorless_needed"),
        F.when(audited_groups > 0, F.lit(100.0) * total("cross") / audited_groups)
        .otherwise(0.0).alias("cross_percent"),
        total("undeclared_ubiquitous").alias("undeclared_ubiquitous"),
    )


def evaluate_gates(metrics: DataFrame) -> DataFrame:
    """Seven rules (gate, measure, value, passed); the first two demand enough evidence."""
    rules = [
        ("semantic_groups", lambda c: c >= MIN_GROUPS_AUDITED),
        ("role_groups", lambda c: c >= MIN_ROLE_GROUPS_AUDITED),
        ("unconfirmed", lambda c: c == 0),
        ("empty_semantic", lambda c: c == 0),
        ("anchorless_needed", lambda c: c == 0),
        ("cross_percent", lambda c: c <= MAX_CROSS_PERCENT),
        ("undeclared_ubiquitous", lambda c: c == 0),
    ]
    rows = [
        F.struct(
            F.lit(i + 1).alias("gate"), F.lit(name).alias("measure"),
            F.col(name).cast("double").alias("value"), rule(F.col(name)).alias("passed"),
        )
        for i, (name, rule) in enumerate(rules)
    ]
    return metrics.select(F.inline(F.array(*rows)))


def token_coverage(df: DataFrame, token: str) -> DataFrame:
    """Rows per token, most frequent first."""
    return (
        df.groupBy(F.col(token).alias("token"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("token"))
    )
