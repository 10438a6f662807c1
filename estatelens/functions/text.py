"""Column expressions over names, types, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.catalogues import words

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: ColumnOrName) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), "^\\s+|\\s+$", "")


def _has_path_marker(lowered: Column) -> Column:
    found = F.lit(False)
    for marker in words.PATH_MARKERS:
        found = found | lowered.contains(marker)
    return found


def is_identifier_key(key: ColumnOrName) -> Column:
    """A tag key shaped like an id: hidden prefix, path, UUID, long hex or ``ns:`` prefix."""
    k = stripped(key)
    lowered = F.lower(k)
    hidden = F.lit(False)
    for prefix in words.HIDDEN_KEY_PREFIXES:
        hidden = hidden | lowered.startswith(prefix)
    namespaced = stripped(F.regexp_extract(k, "^([^:]*):", 1)) != ""
    return (
        hidden
        | _has_path_marker(lowered)
        | k.rlike(words.UUID_PATTERN)
        | k.rlike(words.LONG_HEX_PATTERN)
        | namespaced
    )


def is_identifier_token(token: ColumnOrName) -> Column:
    """A name part that carries a UUID, a long hex run or a path."""
    t = col(token)
    # No pattern or marker fits a shorter part, and most parts are shorter.
    return (F.char_length(t) >= min(len(marker) for marker in words.PATH_MARKERS)) & (
        t.rlike(words.UUID_PATTERN)
        | t.rlike(words.LONG_HEX_PATTERN)
        | t.rlike(words.EMBEDDED_UUID_PATTERN)
        | t.rlike(words.EMBEDDED_HEX_PATTERN)
        | _has_path_marker(F.lower(t))
    )


def is_identifier_value(value: ColumnOrName) -> Column:
    """A tag value shaped like an id, or too long to be an enumeration label."""
    v = stripped(value)
    return is_identifier_token(v) | (F.char_length(v) > words.MAX_TAG_VALUE_LENGTH)


def is_identifier_term(value: ColumnOrName) -> Column:
    """A tag value that must join the term list of a leak scan."""
    v = col(value)
    return (
        _has_path_marker(F.lower(v))
        | v.rlike(words.EMBEDDED_UUID_PATTERN)
        | v.rlike(words.TERM_HEX_PATTERN)
    )


def is_listed(value: ColumnOrName, names) -> Column:
    """Trimmed, case-insensitive membership in a fixed list."""
    return F.lower(stripped(value)).isin(sorted({n.lower() for n in names}))


def canonical_namespace(type_name: ColumnOrName) -> Column:
    """Leading ``microsoft.`` in any case becomes ``Microsoft.``; the rest is kept."""
    return F.regexp_replace(col(type_name), "(?i)^microsoft\\.", "Microsoft.")


def classify_token(token: Column) -> Column:
    lowered = F.lower(token)
    return (
        F.when(token.rlike(words.INTEGER_TOKEN), "int")
        .when(lowered.isin(*words.ENVIRONMENT_TOKENS), "env")
        .when(lowered.isin(*words.REGION_TOKENS), "region")
        .when(token.rlike(words.WORD_TOKEN), "word")
        .otherwise(words.OTHER)
    )


def classify_name(name: ColumnOrName) -> Column:
    """Class of each name part, or NULL for an empty name or one that holds an id."""
    parts = F.filter(F.split(col(name), words.NAME_SEPARATORS), lambda t: t != "")

    def classes(p: Column) -> Column:
        return F.when((F.size(p) > 0) & ~F.exists(p, is_identifier_token), F.transform(p, classify_token))

    # Inside the outer lambda the parts are a variable, so a name is split once.
    return F.get(F.transform(F.array(parts), classes), F.lit(0))


def name_pattern(classes: ColumnOrName) -> Column:
    return F.concat_ws("-", F.transform(col(classes), lambda c: F.concat(F.lit("<"), c, F.lit(">"))))


def group_token(name: ColumnOrName) -> Column:
    """The shape token of ``rg-<unit>-<env>-<token>-<n>``; ``?`` for any other name."""
    parts = F.split(col(name), "-")
    inner = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 4, F.lit(0)))
    return F.when(
        (F.size(parts) >= 4) & (F.element_at(parts, 1) == "rg"), F.array_join(inner, "-")
    ).otherwise("?")


def with_ancestor_types(types: ColumnOrName) -> Column:
    """The types plus every ancestor type, down to ``namespace/type``."""

    def prefixes(t: Column) -> Column:
        parts = F.split(t, "/")
        return F.transform(
            F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
            lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"),
        )

    return F.array_distinct(F.flatten(F.transform(col(types), prefixes)))


def type_segments(type_name: ColumnOrName) -> Column:
    """Struct of the canonical namespace and the nested type segments."""
    parts = F.split(canonical_namespace(type_name), "/")
    segments = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda s: s != "")
    return F.struct(F.element_at(parts, 1).alias("namespace"), segments.alias("segments"))


def group_path(owner: ColumnOrName, group: ColumnOrName) -> Column:
    return F.concat(
        F.lit("/subscriptions/"), col(owner), F.lit("/resourceGroups/"), col(group)
    )


def resource_path(
    owner: ColumnOrName,
    group: ColumnOrName,
    type_name: ColumnOrName,
    name: ColumnOrName,
    parents: ColumnOrName | None = None,
) -> Column:
    """Full path of a row; nested type segments alternate with the parents' names.

    Missing parent names are filled with the row's own name.
    """
    split = type_segments(type_name)
    segments = split["segments"]
    own = col(name).cast("string")
    # Most types have one segment; theirs is a plain concatenation.
    single = F.concat_ws(
        "/", group_path(owner, group), F.lit("providers"), canonical_namespace(type_name), own
    )
    levels = F.greatest(F.size(segments), F.lit(1))
    given = F.lit(None).cast("array<string>")
    if parents is not None:
        given = F.when(col(parents) != "", F.split(col(parents), "/"))
    given = F.coalesce(given, F.array().cast("array<string>"))
    held = F.slice(given, F.lit(1), levels - 1)
    names = F.concat(
        held, F.array_repeat(own, levels - 1 - F.size(held)), F.array(own)
    )
    typed = F.when(F.size(segments) > 0, segments).otherwise(F.array(F.lit("")))
    tail = F.array_join(F.zip_with(typed, names, lambda s, n: F.concat_ws("/", s, n)), "/")
    nested = F.concat_ws(
        "/", group_path(owner, group), F.lit("providers"), split["namespace"], tail
    )
    return F.when(col(type_name).rlike("^[^/]+/[^/]+$"), single).otherwise(nested)


def ancestor_paths(path: ColumnOrName) -> Column:
    """Every proper path prefix of an id, cut at ``/``."""
    p = col(path)
    parts = F.split(p, "/")
    depth = F.size(parts)
    return F.when(
        depth > 1,
        F.filter(
            F.transform(
                F.sequence(F.lit(1), depth - 1),
                lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"),
            ),
            lambda s: s != "",
        ),
    ).otherwise(F.array().cast("array<string>"))


def typed_value(field: ColumnOrName, label: ColumnOrName) -> Column:
    """JSON text of a histogram label in the type of its field; NULL for ``null``."""
    f, v = col(field), col(label)
    return (
        F.when(v == words.NULL_LABEL, F.lit(None).cast("string"))
        .when(f.isin(*words.BOOLEAN_FIELDS), (v == "true").cast("string"))
        .when(
            f.isin(*words.INTEGER_FIELDS) & v.try_cast("bigint").isNotNull(),
            v.try_cast("bigint").cast("string"),
        )
        .otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    )
