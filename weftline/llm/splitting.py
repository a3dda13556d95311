"""Problem 3: splitting oversized items at natural boundaries, by recursive bisection.

An item is cut at the strongest boundary near its midpoint, and each half that still exceeds the limit less
the overlap is cut again; then every piece but the first is extended backwards by the overlap. Strengths,
from strong to weak: blank line, end of line, end of sentence, end of clause or word, end of character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER, CHAR, WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3, 4, 5


def _at(b: np.ndarray, seq: bytes) -> np.ndarray:
    """Positions at which ``seq`` starts, as a mask over b."""
    m = np.zeros(len(b), bool)
    n = len(b) - len(seq) + 1
    if n > 0:
        m[:n] = b[:n] == seq[0]
        for k in range(1, len(seq)):
            m[:n] &= b[k : k + n] == seq[k]
    return m


def strengths(raw: bytes) -> np.ndarray:
    """For each position p in 0..len(raw): how good a cut between bytes p - 1 and p is."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    s = np.full(n + 1, CHAR, np.uint8)
    if not n:
        return s
    nxt = np.append(b, 0)  # byte after the cut
    prev = np.insert(b, 0, 0)  # byte before the cut
    space = (b == 32) | (b == 9) | (b == 10) | (b == 13)
    wide = _at(b, b"\xe3\x80\x80")  # ideographic space
    after_space = np.insert(space, 0, False)
    before_space = np.append(space, False)
    s[after_space & ~before_space] = WORD

    def after(seq: bytes, level: int, closers: bool = False) -> None:
        p = np.flatnonzero(_at(b, seq)) + len(seq)
        if closers and len(p):
            for c in (b"\xe3\x80\x8d", b"\xe3\x80\x8f", b"\xef\xbc\x89", b"\xe2\x80\x9d"):
                hit = _at(b, c)
                p = np.where((p < n) & hit[np.minimum(p, n - 1)], p + len(c), p)
        s[p] = np.maximum(s[p], level)

    for q in (b"\xef\xbc\x8c", b"\xe3\x80\x81", b"\xef\xbc\x9b", b"\xef\xbc\x9a"):  # full-width , 、 ; :
        after(q, WORD)
    s[np.flatnonzero(wide) + 3] = WORD
    # sentence marks followed by blanks: the cut comes after the blanks
    mark = (b == 46) | (b == 33) | (b == 63)
    close = (b == 34) | (b == 39) | (b == 41)
    ended = mark.copy()
    ended[1:] |= close[1:] & mark[:-1]
    for p in np.flatnonzero(ended[:-1] & space[1:]) if n > 1 else ():
        q = p + 1
        while q < n and space[q]:
            q += 1
        s[q] = max(s[q], SENTENCE)
    for q in (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"):  # full-width . ! ?
        after(q, SENTENCE, closers=True)
    line = (prev == 10) | ((prev == 13) & (nxt != 10))
    s[line] = LINE
    twice = np.zeros(n + 1, bool)
    twice[2:] = (b[1:] == 10) & (b[:-1] == 10)
    if n > 3:
        twice[4:] |= (b[3:] == 10) & (b[2:-1] == 13) & (b[1:-2] == 10) & (b[:-3] == 13)
    s[twice] = PARAGRAPH
    # never inside a character: continuation bytes, joiners, variation selectors, combining marks, CR LF
    never = (nxt & 0xC0) == 0x80
    for c in (b"\xe2\x80\x8d", b"\xef\xb8\x8f"):
        never[:-1] |= _at(b, c)
    p = np.flatnonzero(_at(b, b"\xe2\x80\x8d")) + 3
    never[p[p <= n]] = True
    never[:-1] |= (b == 0xCC) | ((b == 0xCD) & (np.append(b[1:], 0) < 0xB0))
    tone = _at(b, b"\xf0\x9f\x8f")
    never[:-1] |= tone & (np.append(b[3:], [0] * min(3, n)) >= 0xBB)
    never |= (prev == 13) & (nxt == 10)
    s[never] = NEVER
    s[0] = s[n] = PARAGRAPH
    return s


def _best(s: np.ndarray, lo: int, hi: int) -> int:
    """The cut of the piece lo..hi: the strongest boundary in the middle half, next to the midpoint; a
    weaker than word boundary only if the piece has no better one anywhere."""
    mid, quarter = (lo + hi) // 2, max(1, (hi - lo) // 4)
    for a, z, least in ((mid - quarter, mid + quarter, WORD), (lo + 1, hi - 1, WORD), (lo + 1, hi - 1, CHAR)):
        a, z = max(a, lo + 1), min(z, hi - 1)
        if a > z:
            continue
        part = s[a : z + 1]
        top = part.max()
        if top >= least:
            p = np.flatnonzero(part == (top if least == WORD else CHAR)) + a
            return int(p[np.argmin(np.abs(p - mid))])
    return -1


def split_bytes(raw: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of the pieces; one whole range if the item is within the limit.

    Every piece has at most ``limit`` bytes, ends and starts on whole characters (clusters of joined
    characters are divided only if one alone exceeds the limit), the pieces cover the item, and each
    piece but the first starts about ``overlap`` bytes before the end of its predecessor. A limit under
    4 counts as 4, an overlap over half the limit as half the limit.
    """
    n = len(raw)
    limit = max(4, limit)
    overlap = max(0, min(overlap, limit // 2))
    if n <= limit:
        return [(0, n)]
    core = max(4, limit - overlap)
    s = strengths(raw)
    cuts, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= core:
            cuts.append((lo, hi))
            continue
        p = _best(s, lo, hi)
        if p < 0:  # one cluster longer than the limit: between code points after all
            b = np.frombuffer(raw[lo:hi], np.uint8)
            ok = np.flatnonzero((b[1:] & 0xC0) != 0x80) + 1
            if hi - lo <= limit and lo == 0 or not len(ok):
                cuts.append((lo, hi))
                continue
            p = lo + int(ok[np.argmin(np.abs(ok - (hi - lo) // 2))])
        todo += [(p, hi), (lo, p)]
    pieces = [cuts[0]]
    for lo, hi in cuts[1:]:
        want = max(lo - overlap, hi - limit, pieces[-1][0] + 1)  # each piece starts after its predecessor
        near = np.flatnonzero(s[want : lo - overlap // 2 + 1] >= WORD) if overlap else ()
        if not len(near):
            near = np.flatnonzero(s[want : lo + 1] >= CHAR)
        pieces.append((min(lo, want + int(near[0])) if len(near) else lo, hi))
    return pieces


_PIECES = "item_id long, piece_no int, n_pieces int, start_byte long, end_byte long, text string"


def _split(batches):
    for pdf in batches:
        rows = []
        for i, raw, limit, overlap in zip(pdf.item_id, pdf.raw, pdf.max_bytes, pdf.overlap_bytes):
            data = raw.encode()
            parts = split_bytes(data, int(limit), int(overlap))
            rows += [(i, k, len(parts), a, z, data[a:z].decode()) for k, (a, z) in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["item_id", "piece_no", "n_pieces", "start_byte", "end_byte", "text"])


def split_oversized(items: DataFrame, limits: DataFrame, id_col: str = "chunk_id", text: str = "raw", key: str = "provider") -> DataFrame:
    """Pieces of every item whose text has more UTF-8 bytes than ``max_bytes`` of its key.

    Columns: the id, piece_no from 0, n_pieces, start_byte, end_byte (in the item's text), text. Items
    within the limit, with a null text, or without a limit for their key give no row. Repeated rows are
    split each for itself; duplicate keys in ``limits`` count with their smallest limit; an empty table
    gives an empty result. Sizes are compared in the JVM; only oversized texts go to Python.
    """
    lim = limits.where(F.col(key).isNotNull() & F.col("max_bytes").isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.min(F.struct("max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("overlap_bytes"))).alias("_lim")
    )
    big = (
        items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).alias("raw"), F.col(key).alias("_key"))
        .join(lim, "_key")
        .where(F.octet_length("raw") > F.col("_lim.max_bytes"))
        .select("item_id", "raw", "_lim.max_bytes", "_lim.overlap_bytes")
    )
    return big.mapInPandas(_split, _PIECES).withColumnRenamed("item_id", id_col)
