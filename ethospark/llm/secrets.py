"""Secret scans: plain patterns, and multipart credentials whose weak parts count only together.

Strong candidates are found by their form alone: assigned values (``assign``), access ids (``access``) and long hexadecimal
runs (``hex``). Weak ones (an account name, a short or unnamed secret, an address) are common in clean text. They are
*parts* with a role, and reported only where complementary parts meet:

* a **scope** is a paragraph (text between blank lines); parts of different scopes never meet;
* within its scope a part has an interval, its own span widened by ``reach`` code points to both sides;
* an ``identifier`` needs a secret in its interval, a ``weak_secret`` needs an identifier, an ``endpoint`` needs
  both, strong or completed themselves. Strong candidates are parts too: ``access`` is an identifier, ``assign`` and ``hex`` are secrets.

All parts of a scope are in one text, so the interval join is a merge of sorted intervals inside the task that reads the
text: n log n in a text's parts, and nothing is shuffled. Offsets are code points.

A null text is empty and has no spans; rows without an id, and repeated rows, are scanned like any other; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import map_batches, strings

Span = tuple[int, int]

#: Kinds of spans; spans with one start come in this order.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
BASE = KINDS[:3]
#: How far, in code points, parts of one credential may lie from each other.
REACH = 200
#: Least lengths: an assigned value, and one that is a weak secret.
ASSIGNED, WEAK_ASSIGNED = 8, 4
#: An unnamed token is a secret from so many bits of entropy a character on.
ENTROPY = 3.5

# The forms of candidates.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMED_IDENTIFIER = re.compile(r"""(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", re.ASCII)
KEY_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,24}(?![A-Za-z0-9])", re.ASCII)
SHORT_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{16,31}(?![A-Za-z0-9])", re.ASCII)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"""(?<![a-z0-9])[a-z][a-z0-9+.-]{1,11}://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])|(?i:host(?:_?name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]+""", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each strong form. A match that is too short is dropped and still ends where it ends.

    Runs of one class start where the class starts, so for them the least length can stand in the pattern.
    """
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGNED],
        "access": [m.span() for m in ACCESS.finditer(text)],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _mixed(token: str) -> bool:
    """Upper and lower case and digits, and few repetitions."""
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= ENTROPY


class Intervals:
    """Spans in order of start, with the furthest end so far: whether any meets an interval is one search."""

    def __init__(self, spans: list[Span]) -> None:
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.furthest: list[int] = []
        for _, e in self.spans:
            self.furthest.append(max(e, self.furthest[-1]) if self.furthest else e)

    def meets(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.starts, hi)
        return k > 0 and self.furthest[k - 1] > lo


def _apart(found: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``found`` that overlap none of ``taken`` and no earlier one of their own."""
    known, out, end = Intervals(taken), [], -1
    for s, e in sorted(found):
        if s >= end and not known.meets(s, e):
            out.append((s, e))
            end = e
    return out


def linked_spans(text: str, base: dict[str, list[Span]], reach: int = REACH) -> dict[str, list[Span]]:
    """The weak parts of ``text`` that complementary parts of the same scope complete."""
    out: dict[str, list[Span]] = {}
    strong = [s for kind in BASE for s in base[kind]]
    identifiers = _apart([m.span() for m in NAMED_IDENTIFIER.finditer(text)] + [m.span() for m in KEY_ID.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])], strong)
    if not identifiers and not base["access"]:
        return out  # no credential without an identifier
    weak = [m.span() for m in ASSIGN.finditer(text) if WEAK_ASSIGNED <= len(m[1]) < ASSIGNED]
    weak += [m.span() for m in SHORT_HEX.finditer(text) if re.search("[a-f]", m[0]) and re.search("[0-9]", m[0])]
    weak = _apart(weak + [m.span() for m in MIXED.finditer(text) if _mixed(m[0])], strong + identifiers)
    if not weak and not base["assign"] and not base["hex"]:
        return out
    cuts = [m.start() for m in BLANK.finditer(text)]

    def around(s: int, e: int) -> Span:
        k, m = bisect_right(cuts, s), bisect_left(cuts, e)
        return max(s - reach, cuts[k - 1] if k else 0), min(e + reach, cuts[m] if m < len(cuts) else len(text))

    names, secrets = Intervals(identifiers + base["access"]), Intervals(weak + base["assign"] + base["hex"])
    out["identifier"] = [x for x in identifiers if secrets.meets(*around(*x))]
    out["weak_secret"] = [x for x in weak if names.meets(*around(*x))]
    names, secrets = Intervals(out["identifier"] + base["access"]), Intervals(out["weak_secret"] + base["assign"] + base["hex"])
    if names.spans and secrets.spans:
        ends = _apart([m.span() for m in ENDPOINT.finditer(text)], strong + identifiers + weak)
        out["endpoint"] = [x for x in ends if names.meets(*around(*x)) and secrets.meets(*around(*x))]
    return out


def spans(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all strong and all completed weak candidates, by start and then as in ``KINDS``."""
    base = base_spans(text)
    found = base | linked_spans(text, base, reach)
    return sorted(((kind, s, e) for kind in KINDS for s, e in found.get(kind, [])), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Rows (id, spans array of (kind, start, end)), one for each row of ``docs``, in one pass without a shuffle."""
    kind = docs.schema[id_col].dataType
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t, reach)] for t in strings(batch, text_col)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, inner)], names=[id_col, "spans"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts of strong candidates, a digest of their places, and all places."""
    only = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(listed(only(*BASE)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
