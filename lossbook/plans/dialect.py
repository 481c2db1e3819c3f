"""Small pieces of the oracle's SQL dialect, so that oracles spell the rules on their own."""

from __future__ import annotations

from lossbook.vocab import COMPANY_SUFFIXES, STOPWORDS


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[a-z0-9]+')"


def tokens(x: str) -> str:
    return f"list_distinct([w FOR w IN {words(x)} IF length(w) > 1 AND w NOT IN ({quoted(STOPWORDS)})])"


def all_tokens(x: str) -> str:
    return f"list_distinct({words(x)})"


def ref(x: str) -> str:
    return f"regexp_replace({norm(x)}, '[^a-z0-9]', '', 'g')"


def form(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def org(x: str) -> str:
    s = "|".join(COMPANY_SUFFIXES)
    return f"regexp_replace(array_to_string({words(x)}, ' '), '(^| )({s})( ({s}))*$', '')"


def lead(x: str) -> str:
    return f"lower(coalesce(list_extract([w FOR w IN regexp_split_to_array(trim({x}), '\\s+') IF length(w) > 2], 1), trim({x})))"


def containment(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(least(len({a}), len({b})), 0), 0.0::DOUBLE)"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0::DOUBLE END)"


def lcs(a: str, b: str) -> str:
    cell = f"CASE WHEN substr({b}, j::INT, 1) = ca THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END"
    row = f"list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, {cell}), [0::BIGINT])"
    zeros = f"[0::BIGINT FOR x IN range(0, length({b}) + 1)]"
    return f"list_extract(list_reduce(string_split({a}, ''), lambda prev, ca: {row}, {zeros}), -1)"


def names(a: str, b: str) -> str:
    """Similarity of organisation normal forms that are columns."""
    shared = containment(f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))")
    ratio = f"2.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b}))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} OR {shared} >= 1 THEN 1.0::DOUBLE ELSE greatest({shared}, {ratio}) END)"


def both(a: str, b: str, then: str) -> str:
    return f"(CASE WHEN coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' THEN {then} END)"


def mean(parts: dict[str, float]) -> str:
    total = " + ".join(f"coalesce({s} * {w}::DOUBLE, 0::DOUBLE)" for s, w in parts.items())
    weight = " + ".join(f"(CASE WHEN {s} IS NOT NULL THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for s, w in parts.items())
    return f"coalesce(({total}) / nullif({weight}, 0), 0.0::DOUBLE)"


def micros(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier}))"
