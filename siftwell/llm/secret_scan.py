"""Secret scan over a sharded trigram inverted index.

Each rule is a regular expression.  From its parse tree a Boolean query over
byte trigrams is derived that every matching text must satisfy.  Each Arrow
batch is a shard: the postings of the trigrams that some query asks for are
built over the whole texts of the shard, every rule's query is evaluated by
intersecting and uniting posting lists, and only the candidates are matched by
the regular expression.  A rule from which no trigram can be derived scans
every text of the shard.

Shards are independent, so the scan is one narrow pass: nothing is shuffled or
collected, and no document, key or group can be hot.

Defined cases: a null text counts as empty and has no spans; a byte that is not
of UTF-8 counts as one code point that no rule names; repeated rows get
the same spans; an empty table gives an empty result; input columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name
from .words import text_buffers


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans leftmost first without overlap; those whose ``group`` has under ``min_chars`` are dropped."""

    kind: str
    pattern: str
    min_chars: int = 0
    group: int = 0


#: Fixed by the query's contract.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Public credential formats that the method adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# ---- Boolean trigram queries: None (any text), a trigram code, ("and", [...]) or ("or", [...])

_MOST = 32  # literals of one exact set before it is turned into a query


def _join(kind: str, parts: list):
    if kind == "and":
        parts = [p for p in parts if p is not None]
    elif any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _fold(raw: bytes) -> bytes:
    """A-Z lowered: the index is kept over folded text, so both letter cases share a trigram."""
    return raw.lower()


def _of_literal(raw: bytes):
    grams = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]
    return _join("and", grams)


def _exact(node) -> set[bytes] | None:
    """All (folded) strings the node can match, where they are few, else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {_fold(chr(arg).encode())}
    if op is sre.IN:
        found: set[bytes] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(_fold(chr(value).encode()))
            elif kind is sre.RANGE and value[1] - value[0] < _MOST:
                found |= {_fold(chr(c).encode()) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3])
    if op is sre.BRANCH:
        sets = [_exact_all(b) for b in arg[1]]
        return None if any(s is None for s in sets) or sum(map(len, sets)) > _MOST else set().union(*sets)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = arg
        inner = _exact_all(body)
        if inner is None or high is sre.MAXREPEAT or high > 4:
            return None
        found, grown = set(), {b""}
        for k in range(high + 1):
            if k >= low:
                found |= grown
            grown = {a + b for a in grown for b in inner}
            if len(grown) > _MOST or len(found) > _MOST:
                return None
        return found
    if op is sre.AT:
        return {b""}
    return None


def _exact_all(nodes) -> set[bytes] | None:
    found = {b""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(found) * len(one) > _MOST:
            return None
        found = {a + b for a in found for b in one}
    return found


def _query(nodes):
    """Query of a sequence: runs of nodes with few exact strings give their trigrams; other nodes give their own query."""
    parts, run = [], {b""}

    def close():
        nonlocal run
        if run != {b""}:
            parts.append(_join("or", [_of_literal(x) for x in run]))
        run = {b""}

    for node in nodes:
        one = _exact(node)
        if one is not None and len(run) * len(one) <= _MOST:
            run = {a + b for a in run for b in one}
            continue
        close()
        if one is not None:
            run = one
            continue
        op, arg = node
        if op is sre.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is sre.BRANCH:
            parts.append(_join("or", [_query(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    close()
    return _join("and", parts)


def trigram_query(pattern: str):
    """The Boolean trigram query that every text matching ``pattern`` satisfies; None where no trigram is mandatory."""
    return _query(sre_parser.parse(pattern))


def query_trigrams(query) -> set[int]:
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*(query_trigrams(p) for p in query[1]))


def build_postings(offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray, chunk: int = 4 << 20) -> dict[int, np.ndarray]:
    """Sorted row numbers of each wanted trigram (``wanted``: 2**24 flags), over folded bytes."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    low, high = int(offsets[0]), int(offsets[-1])
    grams, rows = [], []
    for a in range(low, max(low, high - 2), chunk):
        part = fold[data[a : min(high, a + chunk + 2)]]
        codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        at = np.flatnonzero(wanted[codes])
        row = np.searchsorted(offsets, at + a, "right") - 1
        inside = at + a + 3 <= offsets[row + 1]
        pairs = np.unique(codes[at][inside].astype(np.int64) << 32 | row[inside])
        grams.append(pairs >> 32)
        rows.append(pairs & 0xFFFFFFFF)
    if not grams:
        return {}
    pairs = np.unique(np.concatenate(grams) << 32 | np.concatenate(rows))
    if not len(pairs):
        return {}
    keys, first = np.unique(pairs >> 32, return_index=True)
    return dict(zip(keys.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=True))


def candidates(query, postings: dict[int, np.ndarray], rows: int) -> np.ndarray:
    """Sorted rows that satisfy ``query``."""
    if query is None:
        return np.arange(rows)
    if isinstance(query, int):
        return postings.get(query, np.zeros(0, np.int64))
    lists = [candidates(p, postings, rows) for p in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    lists.sort(key=len)
    found = lists[0]
    for other in lists[1:]:
        if not len(found):
            break
        found = np.intersect1d(found, other, assume_unique=True)
    return found


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``secrets`` more: spans (kind, start, end) in code points, by start, then in the order of ``rules``."""
    out = free_name(docs, "secrets")
    plan = [(r, trigram_query(r.pattern)) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        for _, q in plan:
            wanted[list(query_trigrams(q))] = True
        # a run of the class itself is what the minimum asks for, so it can be part of the pattern
        compiled = [(r, re.compile(r.pattern[:-1] + f"{{{r.min_chars},}}" if r.group == 0 and r.min_chars and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern), q) for r, q in plan]
        for batch in batches:
            texts = batch.column(text_col)
            offsets, data = text_buffers(texts)
            postings = build_postings(offsets, data, wanted)
            found: dict[int, list] = {}
            for place, (rule, pattern, query) in enumerate(compiled):
                for row in candidates(query, postings, len(texts)):
                    a, b = offsets[row], offsets[row + 1]
                    if a == b:
                        continue
                    text = data[a:b].tobytes().decode(errors="replace")
                    for m in pattern.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.min_chars:
                            found.setdefault(int(row), []).append((m.start(), place, m.end(), rule.kind))
            spans = [[{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(found.get(i, ()))] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _ARROW_SPAN)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, SPAN)]))
