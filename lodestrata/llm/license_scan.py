"""Licence scan: one Aho-Corasick pass for notice phrases and tags, then expression parsing.

The text is lower-cased (A-Z), everything that is no word character becomes a blank, and
the words are joined by single blanks. Phrases are looked for as " word word " in that
string, so a hit always covers whole, consecutive words. A document with an SPDX tag also
has the expression behind each tag parsed by the shunting-yard algorithm (``and``,
``or``, ``with``, brackets) and evaluated.

Score: how sure the scan is that the text states a licence. It is 1 minus the product of
(1 - weight) over the distinct pieces of evidence: an expression that parses 0.95, a
named licence (phrase) 0.6, a notice wording such as "licensed under" 0.3.

Verdict: ``permissive``, ``restricted`` or ``none``. An expression is permissive if its
evaluation is: ``or`` needs one side, ``and`` both, ``with`` turns a copyleft licence
permissive where the exception is known. Labels found by phrases must all be permissive.

Defined cases: a null or empty text has no words, no labels and score 0; an expression
that does not parse gives no label, but counts as a notice wording; places of repeated
phrases all count; repeated rows are scanned each; an empty table gives an empty result;
extra columns are ignored. One map over the rows: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import table

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Phrases the method adds.
MORE_PHRASES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "boost software license": "boost",
    "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
NOTICE_WORDS = ("licensed under", "released under", "distributed under", "under the terms of", "permission is hereby granted")
TAG_WORDS = "spdx license identifier"

#: First part of an SPDX identifier and its label.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd",
    "isc": "isc", "bsl": "boost", "0bsd": "bsd", "zlib": "zlib", "unlicense": "public-domain", "cc0": "cc0", "cc": "cc-by",
}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "boost", "zlib", "cc0", "cc-by", "public-domain"}
EXCEPTIONS = {"classpath-exception-2.0", "gcc-exception-3.1", "gcc-exception-2.0", "llvm-exception", "linux-syscall-note",
              "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0", "openssl-exception"}

TAG_RE = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN_RE = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
BINDING = {"or": 1, "and": 2, "with": 3}

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, verdict string, expressions array<string>")

# A-Z to a-z; every byte that is no word character (0-9, a-z, 0x80 and above) to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def label_of(identifier: str) -> str:
    low = identifier.lower()
    for longer in ("cc-by-nc", "cc-by-nd", "cc-by-sa"):
        if low.startswith(longer):
            return longer
    return FAMILIES.get(re.split(r"[-+.]", low)[0], low)


def to_postfix(text: str) -> list[str]:
    """Shunting-yard over the longest prefix of ``text`` that is an expression; empty if there is none.

    Tokens behind a complete expression (a comment end, prose) are left alone.
    """
    out, stack, want_operand, depth, at = [], [], True, 0, 0
    best: list[str] = []
    while (m := TOKEN_RE.match(text, at)):
        at = m.end()
        bracket, word = m.groups()
        operator = word and word.lower() in BINDING and word.lower()
        if want_operand:
            if bracket == "(":
                stack.append("(")
                depth += 1
                continue
            if bracket or operator:
                break
            out.append(word)
            want_operand = False
        elif bracket == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif operator:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[operator]:
                out.append(stack.pop())
            stack.append(operator)
            want_operand = True
            continue
        else:
            break
        if not depth:
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str]) -> tuple[bool, set[str]]:
    """Whether the expression can be used permissively, and the labels it names."""
    stack: list[tuple[bool, set[str]]] = []
    for token in postfix:
        if token not in BINDING:
            label = label_of(token)
            stack.append((label in PERMISSIVE or token.lower() in EXCEPTIONS, {label}))
            continue
        (b, b_labels), (a, a_labels) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a or b, a_labels))  # the right side names an exception, no licence
        else:
            stack.append(((a or b) if token == "or" else (a and b), a_labels | b_labels))
    return stack[0]


def automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for phrase, entry in [*((p, ("base", lab)) for p, lab in BASE_PHRASES.items()),
                          *((p, ("more", lab)) for p, lab in MORE_PHRASES.items()),
                          *((p, ("notice", p)) for p in NOTICE_WORDS), (TAG_WORDS, ("tag", ""))]:
        key = f" {phrase} ".encode().decode("latin-1")
        found.add_word(key, (len(key), *entry))
    found.make_automaton()
    return found


def scan_text(text: bytes, phrases) -> tuple:
    """The result columns of one text (UTF-8 bytes), without doc_id."""
    words = text.translate(_FOLD).split()
    line = b" %b " % b" ".join(words)
    n_base, first, last = 0, None, None
    base, labels, notices, tagged = set(), set(), set(), False
    for end, (length, kind, label) in phrases.iter(line.decode("latin-1")):
        if kind == "base":
            start = end - length + 1
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(label)
        elif kind == "more":
            labels.add(label)
        elif kind == "notice":
            notices.add(label)
        else:
            tagged = True
    miss = (0.4 ** len(base | labels)) * (0.7 ** len(notices))
    usable, expressions = [label in PERMISSIVE for label in base | labels], []
    if tagged:
        for m in TAG_RE.finditer(text.decode(errors="replace")):
            postfix = to_postfix(m.group(1))
            if not postfix:
                miss *= 0.7
                continue
            ok, named = evaluate(postfix)
            usable.append(ok)
            labels |= named
            expressions.append(" ".join(postfix))
            miss *= 0.05
    at = [None if p is None else line.count(b" ", 0, p) for p in (first, last)]
    verdict = "none" if not usable else "permissive" if all(usable) else "restricted"
    return (len(words), n_base, *at, ",".join(sorted(base)), ",".join(sorted(base | labels)),
            round(1.0 - miss, 6), verdict, expressions)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: number of words, places and labels of licences, score and verdict."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string())]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan_text(t.as_py() or b"", phrases) for t in batch.column(1).cast(pa.binary())]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
