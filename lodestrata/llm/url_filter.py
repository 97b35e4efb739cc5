"""URL filter: all wildcard rules run at once over each URL as one bit-parallel automaton.

Every rule is a glob over the canonical URL. The literal characters of all globs
are laid one after the other into the bits of a multiword Shift-And mask; a ``*``
is a self-loop on the bit before it. One pass over the characters of a URL
advances every rule together, and a batch of URLs advances one character per
numpy step.

Canonical form: a dot, the host with A-Z lower-cased, the byte ``\\xff`` (it never
occurs in UTF-8), the path. With the dot in front, ``*.example.com`` stands for the
host and all its subdomains; no wildcard of a host part crosses the ``\\xff``.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is
judged like any other (no rule fits, so the verdict is the default). Rows are judged
one by one: repeated rows get equal verdicts, an empty table gives an empty result,
extra columns are ignored. Ties between rules of equal length go to the earlier rule.
The operator is one map over the rows: nothing is shuffled, and the rule masks (a few
hundred bytes a rule) travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import table

SEP = 0xFF

#: (verdict, host, path) as given by the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Globs of the method itself, for URLs that no rule fits: (host glob, path glob).
SPAM_GLOBS = (
    ("*adult*", "*"), ("*porn*", "*"), ("*xxx*", "*"), ("*casino*", "*"), ("*bets.*", "*"), ("*-bet*", "*"),
    ("*.ads.*", "*"), ("*.adserver.*", "*"), ("*.doubleclick.net", "*"),
    ("*", "*/ads/*"), ("*", "*/wp-login*"), ("*", "*/cgi-bin/*"), ("*", "*.exe"), ("*", "*.zip"),
)

SCHEMA = "page_id long, host string, path string, rule string, verdict string, spam_glob string"


@dataclass(frozen=True)
class Automaton:
    """Masks of all globs: bit i of a glob stands for i matched characters."""

    start: np.ndarray  # (W,)
    enter: np.ndarray  # (256, W): bits a character may move into
    stay: np.ndarray  # (256, W): bits that a wildcard keeps on a character
    accept: list[tuple[int, int]]  # (word, bit) of each glob's last state


def compile_globs(globs: list[tuple[str, str]]) -> Automaton:
    """Lay (host glob, path glob) pairs into masks; ``*`` and ``?`` are the wildcards."""
    layouts = []
    for host, path in globs:
        cells: list[tuple[int | None, bool]] = []  # (byte or None for ?, in the host part)
        loops: dict[int, bool] = {}  # state -> whether the loop is in the host part
        for part, in_host in ((host.encode(), True), (b"%c" % SEP, True), (path.encode(), False)):
            for c in part:
                if c == ord("*"):
                    loops[len(cells)] = in_host and loops.get(len(cells), True)
                else:
                    cells.append((None if c == ord("?") else c, in_host))
        layouts.append((cells, loops))
    bits = sum(len(cells) + 1 for cells, _ in layouts)
    words = (bits + 63) // 64
    start, enter, stay = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    accept, at = [], 0

    def put(mask, bit):
        mask[..., bit // 64] |= np.uint64(1 << (bit % 64))

    for cells, loops in layouts:
        put(start, at)
        for state, in_host in loops.items():
            chars = [c for c in range(256) if not (in_host and c == SEP)]
            stay[chars, (at + state) // 64] |= np.uint64(1 << ((at + state) % 64))
        for i, (c, _) in enumerate(cells):
            for x in ([c] if c is not None else [c for c in range(256) if c != SEP]):
                enter[x, (at + i + 1) // 64] |= np.uint64(1 << ((at + i + 1) % 64))
        accept.append(((at + len(cells)) // 64, (at + len(cells)) % 64))
        at += len(cells) + 1
    return Automaton(start, enter, stay, accept)


def simulate(automaton: Automaton, texts: list[bytes]) -> np.ndarray:
    """Which glob accepts which text: a boolean array (texts, globs).

    Texts are taken longest first, so the texts that still have characters are a
    prefix at every step; memory is the bytes of the texts plus one state each.
    """
    n = len(texts)
    lengths = np.fromiter((len(t) for t in texts), np.int64, n)
    order = np.argsort(-lengths, kind="stable")
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    state = np.tile(automaton.start, (n, 1))
    one, top = np.uint64(1), np.uint64(63)
    live = n
    for step in range(int(lengths[0]) if n else 0):
        while live and lengths[live - 1] <= step:
            live -= 1
        chars = buffer[begin[:live] + step]
        now = state[:live]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        state[:live] = (moved & automaton.enter[chars]) | (now & automaton.stay[chars])
    found = np.empty((n, len(automaton.accept)), bool)
    for g, (word, bit) in enumerate(automaton.accept):
        found[order, g] = (state[:, word] >> np.uint64(bit)) & one
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the contract cuts them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    host = rest[:cut].encode(errors="replace").lower().decode()  # bytes.lower touches A-Z only
    return host, tail[:end]


def judge_urls(pages: DataFrame, rules=RULES, spam_globs=SPAM_GLOBS, default: str = "allow") -> DataFrame:
    """One row per page: host, path, the longest fitting rule and the verdict.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains when the
    path starts with the rule's. Without a fitting rule a match of ``spam_globs`` blocks;
    otherwise the verdict is ``default``. ``spam_glob`` names the first match.
    """
    rules, spam_globs = list(rules), list(spam_globs)
    by_length = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    ordered = [rules[i] for i in by_length]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_globs([(f"*.{host}", f"{path}*") for _, host, path in ordered] + spam_globs)
        n_rules = len(ordered)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = simulate(automaton, [b"." + h.encode() + b"\xff" + p.encode(errors="replace") for h, p in parts])
            # A column of True behind the last glob makes argmax give "none" where nothing matched.
            none = np.ones((len(parts), 1), bool)
            best = np.hstack([found[:, :n_rules], none]).argmax(1)
            spam = np.hstack([found[:, n_rules:], none]).argmax(1)
            rule, verdict, glob = [], [], []
            for b, s in zip(best.tolist(), spam.tolist()):
                fit = ordered[b] if b < n_rules else None
                rule.append(fit and fit[1] + fit[2])
                verdict.append(fit[0] if fit else "block" if s < len(spam_globs) else default)
                glob.append("".join(spam_globs[s]) if s < len(spam_globs) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([h for h, _ in parts], pa.string()),
                 pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string()), pa.array(glob, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "spam_glob"])

    return pages.select("page_id", "url").mapInArrow(judge, SCHEMA)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql_globs() -> str:
    """The method's globs as SQL: the first matching one."""
    def like(column, glob):
        return f"{column} LIKE '{glob.replace('%', '!%').replace('_', '!_').replace('*', '%')}' ESCAPE '!'"
    cases = " ".join(f"WHEN {like('dotted', h)} AND {like('path', p)} THEN '{h}{p}'" for h, p in SPAM_GLOBS)
    return f"CASE {cases} END"


ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
judged AS (
  SELECT page_id, host, path, '.' || host AS dotted,
    CASE WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
         WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts),
spam AS (SELECT *, {_sql_globs()} AS spam_glob FROM judged)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN spam_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, spam_glob
FROM spam
"""
