"""URL filters: glob rules packed into a multiword Shift-And automaton.

All rules run at once over a whole batch of URLs: one vector step per character position,
with one row of 64-bit words per URL. A rule's literal characters and `?` take one state
each; `*` keeps the state before it alive on any character.

A URL is canonicalised to `.host<US>path`: the unit separator appears once, so a `*` of a
rule's host part cannot match into a path that imitates a host, and the leading dot lets
`*.example.com` match the host itself as well as its subdomains.

Defined results: a null URL or one without `://` has an empty host and path and matches no
rule; of rules that fit the longest wins, host and path together, and of equally long ones the first
listed; very long URLs are matched whole, one step a character; repeated rows are judged each on its
own; an empty table gives an empty result; other columns of the input pass through, but for those called like a
result in any case, which are replaced, the URL's own column too if it is called so. Rules come as they are listed or from a
table of MAX_RULES rows at most (`rules_of`), as every worker holds their automaton.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .common import small_batches, table, tidied, unused

SEP = "\x1f"
#: URLs stepped together; long ones are stepped with others of about their length.
STEP_ROWS = 2048
MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A glob over the host and one over the path; the longest matching name wins."""

    name: str
    host: str
    path: str
    verdict: str

    @property
    def glob(self) -> str:
        return f"{self.host}{SEP}{self.path}"


def under(host: str, path: str, verdict: str) -> Rule:
    """The rule for a host with all its subdomains and a path prefix."""
    return Rule(host + path, f"*.{host}", f"{path}*", verdict)


def rules_of(table_: DataFrame) -> tuple[Rule, ...]:
    """Rules from rows (host, path, verdict): a host with all its subdomains and a path prefix, either with `*` and `?` as in globs; in order of their bytes."""
    rows = table_.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return tuple(under(*r) for r in sorted(map(tuple, rows)))


# The rules of the standing contract, in its order.
CONTRACT_RULES = (
    under("com", "/", "allow"),
    under("example.com", "/en/", "block"),
    under("www.example.com", "/en/", "allow"),
    under("net", "/es/", "block"),
    under("net", "/fr/", "block"),
)

#: The method's own rules, for URLs on which no rule above has a say. Host words are matched
#: anywhere in a label.
DEFAULT_RULES = tuple(Rule(f"*{w}*", f"*{w}*", "*", "block") for w in ("spam", "casino", "pills", "porn", "xxx", "phish", "malware", "warez"))
DEFAULT_VERDICT = "allow"


class Automaton:
    """Shift-And over many globs, in ceil(states / 64) words for each URL."""

    def __init__(self, globs: list[str]) -> None:
        literals, loops, finals, firsts, always, empties = [], [], [], [], [], []
        for g in globs:
            start = len(literals)
            lead = False
            for c in g:
                if c != "*":
                    literals.append(c)
                    loops.append(False)
                elif len(literals) == start:
                    lead = True
                else:
                    loops[-1] = True
            if len(literals) == start:  # only stars: one state that any character keeps
                empties.append((len(finals), lead))
                finals.append(-1)
                continue
            firsts.append(start)
            if lead:
                always.append(start)
            finals.append(len(literals) - 1)
        self.finals = finals
        self.empty_match = dict(empties)
        n = len(literals)
        self.words = max(1, -(-n // 64))
        self.first, self.always, self.loop = self._mask(firsts), self._mask(always), self._mask([i for i, x in enumerate(loops) if x])
        chars = sorted({c for c in literals if c != "?"})
        self.column = {c: i + 1 for i, c in enumerate(chars)}
        any_char = [i for i, c in enumerate(literals) if c == "?"]
        self.by_char = np.stack([self._mask(any_char + [i for i, x in enumerate(literals) if x == c]) for c in ["", *chars]])
        # a lookup by code point for the usual characters; others go to column 0
        self.lookup = np.zeros(0x110000, np.int32)
        for c, i in self.column.items():
            self.lookup[ord(c)] = i

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def _step_all(self, texts: list[str]) -> np.ndarray:
        """Final states of texts, which are sorted by length, longest first."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts])
        codes = self.lookup[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.zeros((n, self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths[0]) if n else 0):
            k = int(np.searchsorted(-lengths, -i, "left"))  # texts longer than i
            d = state[:k]
            shifted = d << one
            if self.words > 1:
                shifted[:, 1:] |= d[:, :-1] >> top
            shifted &= ~self.first
            shifted |= self.first if i == 0 else self.always
            state[:k] = (shifted & self.by_char[codes[starts[:k] + i]]) | (d & self.loop)
        return state

    def match(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a boolean for each glob."""
        out = np.zeros((len(texts), len(self.finals)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for at in range(0, len(order), STEP_ROWS):
            part = order[at : at + STEP_ROWS]
            state = self._step_all([texts[i] for i in part])
            for j, b in enumerate(self.finals):
                if b >= 0:
                    out[part, j] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1
                else:
                    out[part, j] = self.empty_match[j] or np.array([not texts[i] for i in part])
        return out


_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    if not url:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def canonical(host: str, path: str) -> str:
    return f".{host.replace(SEP, ' ')}{SEP}{path.replace(SEP, ' ')}"


class Judge:
    def __init__(self, rules: tuple[Rule, ...], defaults: tuple[Rule, ...], verdict: str) -> None:
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        self.defaults, self.verdict = defaults, verdict

    @functools.cached_property
    def automaton(self) -> Automaton:
        """Built where it is used, once in a worker."""
        return Automaton([r.glob for r in [*self.rules, *self.defaults]])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """Rule name or null, and verdict, of each (host, path)."""
        if not self.rules and not self.defaults:
            return [(None, self.verdict)] * len(parts)
        hits = self.automaton.match([canonical(*p) for p in parts])
        hits = np.hstack([hits, np.zeros((len(hits), 1), bool)])  # what never fits, for a side without rules
        k = len(self.rules)
        first = hits[:, :k].argmax(axis=1) if k else np.zeros(len(hits), int)
        ruled = hits[:, :k].any(axis=1)
        late, which = hits[:, k:].any(axis=1), hits[:, k:].argmax(axis=1)
        out = []
        for i in range(len(parts)):
            if ruled[i]:
                r = self.rules[first[i]]
                out.append((r.name, r.verdict))
            else:
                out.append((None, self.defaults[which[i]].verdict if late[i] else self.verdict))
        return out


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[Rule, ...] = CONTRACT_RULES,
    defaults: tuple[Rule, ...] = DEFAULT_RULES,
    verdict: str = DEFAULT_VERDICT,
) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names, in any case, are replaced."""
    added = [StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")]
    names = {f.name for f in added}
    kept = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c.lower() not in names])
    (read,) = unused(kept, "__read")
    rows = pages.select(*[pages[f"`{c}`"] for c in kept.columns], pages[f"`{url}`"].alias(read))
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(Judge(rules, defaults, verdict))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for b in batches:
            parts = [split_url(u) for u in b.column(b.num_columns - 1).to_pylist()]
            said = judge.judge(parts)
            new = zip(*[(*p, *s) for p, s in zip(parts, said, strict=True)], strict=True) if parts else ([],) * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, pa.string()) for x in new]], [*b.schema.names[:-1], *[f.name for f in added]])

    return rows.mapInArrow(tidied(judged), StructType([*kept.schema.fields, *added]))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_SQL_RULES = "\n".join(
    f"      WHEN path LIKE '{r.path.replace('*', '%')}' AND (host = '{r.host[2:]}' OR host LIKE '%.{r.host[2:]}') THEN '{{{r.name}}}'"
    for r in sorted(CONTRACT_RULES, key=lambda r: -len(r.name))
)
_SQL_BAD = " OR ".join(f"contains(host, '{r.host.strip('*')}')" for r in DEFAULT_RULES)
ORACLE_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(r, '/') THEN substr(r, position('/' IN r)) ELSE '' END AS path FROM rest
), ruled AS (
  SELECT *, CASE
{_SQL_RULES.replace("{", "").replace("}", "")}
    END AS rule FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({", ".join(f"'{r.name}'" for r in CONTRACT_RULES if r.verdict == "block")}) THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow' WHEN {_SQL_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
