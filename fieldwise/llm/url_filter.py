"""URL filter: a weighted vocabulary found by Aho-Corasick, under host and path rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One strict term rejects a URL; of the soft terms it takes several different ones.
STRICT = ("adult", "casino", "escort", "gambling", "porn", "viagra", "xxx")
SOFT = ("ads", "bet", "bonus", "cheap", "click", "farm", "free", "loan", "pills", "spam", "win")
MIN_SOFT = 2

# (verdict, host, path prefix); a rule holds for the host and all its subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

SCHEMA = "host string, path string, rule string, strict_terms int, soft_terms int, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty where there is no '://'."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return _lower(rest[:end]), path[:stop]


_UPPER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_UPPER)


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(_lower(term), (_lower(term), False))
    for term in strict:  # a term in both lists is strict
        found.add_word(_lower(term), (_lower(term), True))
    if len(found):
        found.make_automaton()
    return found


def judge_urls(
    df: DataFrame,
    url: str = "url",
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    min_soft: int = MIN_SOFT,
    rules: Sequence[tuple[str, str, str]] = RULES,
    into: str = "url_verdict",
) -> DataFrame:
    """Adds a struct column `into`: host, path, the rule that holds, terms found, allow or block.

    Terms count where neither neighbour is an ASCII letter or digit, in the URL with A-Z lower-cased.
    The longest rule (host and path together; among equals the first by text) decides; without one, a
    strict term or `min_soft` different soft terms block. A null or empty URL has empty host and path, no
    terms and is allowed. Rows, order and other columns stay; an existing column `into` is replaced. One
    pass, no shuffle; the vocabulary travels with the function, so it must fit a task closure.
    """
    strict, soft = tuple(strict), tuple(soft)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        by_host.setdefault(host, []).append((path, verdict))

    def rule_of(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for prefix, verdict in by_host.get(suffix, ()):  # longest first
                if path.startswith(prefix):
                    name = suffix + prefix
                    if best is None or (-len(name), name) < best[:2]:
                        best = (-len(name), name, verdict)
                    break
        return (best[1], best[2]) if best else (None, None)

    @F.pandas_udf(SCHEMA)
    def judge(urls: pd.Series) -> pd.DataFrame:
        found = _automaton(strict, soft)
        rows = []
        for value in urls:
            host, path = split_url(value)
            rule, verdict = rule_of(host, path)
            text, hits = _lower(value or ""), set()
            for end, (term, is_strict) in found.iter(text) if len(found) and text else ():
                start = end - len(term)
                if (start < 0 or not _word(text[start])) and (end + 1 == len(text) or not _word(text[end + 1])):
                    hits.add((term, is_strict))
            n_strict = sum(s for _, s in hits)
            n_soft = len(hits) - n_strict
            if verdict is None:
                verdict = "block" if n_strict or n_soft >= min_soft else "allow"
            rows.append((host, path, rule, n_strict, n_soft, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "strict_terms", "soft_terms", "verdict"])

    return df.withColumn(into, judge(F.col(url)))


def oracle(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT, rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same over `pages` as DuckDB SQL."""

    def has(term: str) -> str:
        pattern = "(^|[^a-z0-9])" + "".join("\\" + c if not c.isalnum() else c for c in term) + "($|[^a-z0-9])"
        return f"cast(regexp_matches(low, '{pattern}') as int)"

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')") for v, h, p in ordered]
    rule = "case " + " ".join(f"when {c} then '{n}'" for _, n, c in fits) + " end"
    ruled = "case " + " ".join(f"when {c} then '{v}'" for v, _, c in fits) + " end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with cut as (select page_id, translate(coalesce(url, ''), '{upper}', '{lower}') as low,
    case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
parts as (select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
terms as (select *, {' + '.join(map(has, strict))} as strict_terms, {' + '.join(map(has, soft))} as soft_terms from parts)
select page_id, host, path, {rule} as rule, strict_terms, soft_terms,
    coalesce({ruled}, case when strict_terms > 0 or soft_terms >= {min_soft} then 'block' else 'allow' end) as verdict from terms"""
