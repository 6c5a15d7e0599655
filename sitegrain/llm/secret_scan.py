"""Secret scanning over a trigram inverted index.

Every rule is a regular expression. ``trigram_query`` derives from its parse tree which trigrams any
match must contain: an AND of ORs of ANDs (a literal run gives the AND of its trigrams, alternatives
their OR). Each chunk of documents gets postings (trigram -> documents) for the trigrams that the
rules ask for; a rule's query intersects and unites postings, and only the documents left are
scanned with the regex itself. A rule without mandatory trigrams scans every document.

Trigrams are of bytes with A-Z lower-cased, so one index serves rules of either case.

The base kinds are ``assign``, ``access`` and ``hex``; further kinds are tokens of well-known
issuers' formats and private key headers. Spans are in code points, end exclusive.

Defined results: null and empty texts have no spans: zero counts and the digest of the empty string.
Repeated rows are scanned each. Extra columns are ignored, whatever their names. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.llm import vectors as V
from sitegrain.llm.scratch import prepare

#: Kind -> (pattern, least length of a group, that group). In the order in which ties of spans are listed.
BASE_RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"[0-9a-f]+", 32, 0),
}
MORE_RULES = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 39, 0),
    "stripe": (r"[sr]k_live_[A-Za-z0-9]{16,}", 24, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0),
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?", 0, 0),
}
RULES = BASE_RULES | MORE_RULES

#: True where nothing is mandatory, else ("and" | "or", [queries and trigrams]).
Query = object


def _join(kind: str, parts: list) -> Query:
    parts = list(dict.fromkeys(x for x in parts if x is not True or kind == "or"))
    if kind == "or" and (True in parts or not parts):
        return True
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _and_trigrams(runs: Iterable[str]) -> Query:
    return _join("and", [run[i : i + 3] for run in runs for i in range(len(run) - 2)])


#: A piece of a pattern is exact (a set of all its lower-case strings, at most so many) or only known by its query.
EXACT = 40


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of ``pattern`` satisfies."""

    def either(strings: set[str]) -> Query:
        return _join("or", [_and_trigrams([x]) if len(x) >= 3 else True for x in sorted(strings)])

    def seq(items: Iterable) -> tuple[set[str] | None, Query]:
        """(all strings that it can be, or None; what else is known of it)."""
        exact, queries, complete = {""}, [], True
        for part, query in map(one, items):
            queries.append(query)
            if part is not None and len(exact) * len(part) <= EXACT:
                exact = {a + b for a in exact for b in part}
            else:
                queries.append(either(exact))
                exact, complete = part or {""}, False
        return (exact if complete else None), _join("and", queries if complete else [*queries, either(exact)])

    def one(item) -> tuple[set[str] | None, Query]:
        op, arg = item
        if op is C.LITERAL:
            return ({chr(arg).lower()} if arg < 128 else None), True
        if op is C.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is C.LITERAL and value < 128:
                    chars.add(chr(value).lower())
                elif kind is C.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                    chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
                else:
                    return None, True
            return (chars, True) if len(chars) <= 8 else (None, True)
        if op is C.SUBPATTERN:
            return alternatives([arg[3]])
        if op is C.BRANCH:
            return alternatives(arg[1])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            if low == high == 1:
                return alternatives([body])
            strings, query = alternatives([body])
            if low == 0 and high == 1 and strings is not None:
                return strings | {""}, True
            if low == 0:
                return None, True
            return None, _join("and", [query, either(strings) if strings is not None else True])
        return None, True

    def alternatives(bodies: list) -> tuple[set[str] | None, Query]:
        strings: set[str] | None = set()
        queries = []
        for s, q in map(seq, bodies):
            queries.append(q if s is None else _join("and", [q, either(s)]))
            strings = None if strings is None or s is None or len(strings | s) > EXACT else strings | s
        return (strings, True) if strings is not None else (None, _join("or", queries))

    strings, query = alternatives([_parser.parse(pattern)])
    return either(strings) if strings is not None else query


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Scanner:
    """Rules with their queries, and the index of a chunk of texts."""

    def __init__(self, rules: dict[str, tuple[str, int, int]]):
        self.rules = {k: (re.compile(p, re.ASCII), least, group) for k, (p, least, group) in rules.items()}
        self.order = {k: i for i, k in enumerate(rules)}
        self.queries = {k: trigram_query(p) for k, (p, _, _) in rules.items()}
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries.values())))
        self.wanted = np.zeros(1 << 21, bool)  # by three 7-bit bytes: mandatory trigrams are ASCII
        self.wanted[[self._code(t) for t in self.trigrams]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    @staticmethod
    def _code(t: str) -> int:
        a, b, c = t.encode()
        return a << 14 | b << 7 | c

    def postings(self, data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """trigram -> sorted rows that have it, for the trigrams that the rules ask for."""
        low = self.lower[data]
        seven = (low & 127).astype(np.uint32)
        code = (seven[:-2] << 14) | (seven[1:-1] << 7) | seven[2:] if len(low) > 2 else np.empty(0, np.uint32)
        at = np.flatnonzero(self.wanted[code])
        at = at[(low[at] < 128) & (low[at + 1] < 128) & (low[at + 2] < 128)]
        row = np.searchsorted(off, at, "right") - 1
        keep = at + 3 <= off[row + 1]
        pairs = np.unique(code[at[keep]].astype(np.int64) << 32 | row[keep])
        codes, rows = pairs >> 32, pairs & 0xFFFFFFFF
        return {t: rows[np.searchsorted(codes, self._code(t)) : np.searchsorted(codes, self._code(t), "right")] for t in self.trigrams}

    def candidates(self, query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings[query]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, True) if query[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, texts: Callable[[int], str], data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """row -> its spans (start, end, kind) by start, then kind as listed."""
        n = len(off) - 1
        postings = self.postings(data, off)
        found: dict[int, list[tuple[int, int, str]]] = {}
        for kind, (pattern, least, group) in self.rules.items():
            for i in self.candidates(self.queries[kind], postings, n).tolist():
                for m in pattern.finditer(texts(i)):
                    if m.end(group) - m.start(group) >= least:
                        found.setdefault(i, []).append((m.start(), m.end(), kind))
        for spans in found.values():
            spans.sort(key=lambda x: (x[0], self.order[x[2]], x[1]))
        return found


def _scan(rules: dict[str, tuple[str, int, int]], text: str):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for rows, data, off in V.chunks(batches, text):
            texts = rows.column(text).to_pylist()
            found = scanner.scan(lambda i, texts=texts: texts[i] or "", data, off)
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in found.get(i, ())] for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, kind)], [*rows.schema.names, "spans"])

    return run


def scan_documents(spark: SparkSession, docs: DataFrame, text_col: str = "text", rules: dict[str, tuple[str, int, int]] = RULES, spans_col: str = "spans") -> DataFrame:
    """Every row of ``docs`` with its secrets in ``spans_col``, as array<struct<start, end, kind>> in code points."""
    prepare(spark)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the names, they don't clash
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([*named.schema.fields, T.StructField("spans", T.ArrayType(span))])
    run = _scan(rules, f"c{docs.columns.index(text_col)}")
    return named.mapInArrow(run, schema).toDF(*docs.columns, spans_col)


def redacted(text, spans):
    """Column: ``text`` with each span replaced by ``[kind]``; of overlapping spans the first counts."""
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))).otherwise(a)
    whole = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans as text."""
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_RULES))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(of(k).alias(f"n_{k}") for k in BASE_RULES),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


def spans_of(text: str | None, rules: dict[str, tuple[str, int, int]] = RULES) -> list[tuple[int, int, str]]:
    """Spans of one text by the rules alone, without an index (for tests)."""
    out = [(m.start(), m.end(), k) for k, (p, least, g) in rules.items() for m in re.compile(p, re.ASCII).finditer(text or "") if m.end(g) - m.start(g) >= least]
    order = {k: i for i, k in enumerate(rules)}
    return sorted(out, key=lambda x: (x[0], order[x[2]], x[1]))


def base_digest(text: str | None) -> str:
    spans = [x for x in spans_of(text) if x[2] in BASE_RULES]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
