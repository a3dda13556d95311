"""Problem 2: texts cut off by field limits or broken transfers.

Two kinds of evidence are joined. Lengths: every text is measured in characters, UTF-8 bytes, UTF-16 units and
after entity escaping, JSON escaping and newline conversion; grouped by source, table and measure, a hidden storage
limit shows as a pile of texts at one length, the greatest or another. Endings: whether the last words can end a sentence is read off all
texts, by how often the same last three, two or one words (Chinese: four, three, two characters) stand before a
mark and how often they go on.

Different texts count once. Words and their sequences are numbers of 64 bits; the texts to be judged by their endings
are few, so a bitmap of fixed size of the sequences they end on keeps the rest from being shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

# What writers put after a break.
MARKERS = (
    r"(?i)(?:\s*(?:…|\.\.\.|\[(?:[^\]\n]{0,24}\b(?:cut|truncated|snip|snipped|more|continued|shortened)\b[^\]\n]{0,24}|\.\.\.|…)\]"
    r"|\((?:cut|truncated|more|continued|cont\.|to be continued|text truncated|\.\.\.|…)\)|<(?:cut|truncated|more|snip)>|&hellip;|�))+\s*$"
)
#: What every marker ends on; most texts do not, and need no search for one.
MARKED_ENDS = "…])>;�"
# Marks that end a sentence, what may close behind them, and what ends a text by itself.
MARKS, CLOSERS, ENDS = ".!?。！？", "\"'”’」』)]）", ")）]`」』"
BLANKS = " \t\n\x0b\f\r"

#: A pile: at least so many different texts, and this share of the source's, within SLACK below a length, and so many
#: times as dense as the lengths below it and those above it.
PILE_TEXTS, PILE_SHARE, PILE_DENSITY, SLACK, BELOW = 4, 0.005, 5, 3, 40
#: Least share of the occurrences of an ending that stand before a mark.
CAN_END = 0.08
#: A labelled tail is whole if so many different texts end on it, and this share of all texts that have it.
TAIL_TEXTS, TAIL_SHARE = 3, 0.5

_HAN = r"㐀-鿿豈-﫿"
_TOKEN = re.compile(r"[A-Za-z0-9][\w/.\-']*[A-Za-z0-9/_]|[A-Za-z0-9]", re.A)
_CJK = re.compile(f"[{_HAN}]")
_LABELLED = re.compile(r"(?:^|(?<=[\s。.]))([A-Z][a-z]+: [^.:\n]{1,60})")
_LABEL = re.compile(r"(?:^|[\s。.])([A-Z][a-z]+: [^.:\n]{1,40})$")
_PATH = re.compile(r"^[\w\-]+(?:/[\w\-]+)+(\.\w+)?$")


def _last(text: Column, n: int = 1) -> Column:
    return F.right(text, F.lit(n))


def may_be_marked(text: Column) -> Column:
    """Whether a text ends on what markers end on; true wherever a marker follows."""
    x = F.rtrim(text, F.lit(BLANKS))
    return _last(x).isin(*MARKED_ENDS) | (_last(x, 3) == "...")


def is_final(body: Column) -> Column:
    """Whether a text ends on a mark, closed or not, or on a closing sign."""
    return _last(body).isin(*ENDS) | _last(F.rtrim(body, F.lit(CLOSERS))).isin(*MARKS)


def on_path(body: Column) -> Column:
    """Whether the last word is a path."""
    word = body
    for blank in BLANKS:
        word = F.substring_index(word, blank, -1)
    return word.contains("/") & word.rlike(r"^[\w\-]+(?:/[\w\-]+)+\.?$")


def measures(text: Column) -> dict[str, Column]:
    """Lengths of a text under the encodings and escapings that storage applies."""
    chars, octets = F.char_length(text), F.octet_length(text)
    of = lambda sign: chars - F.char_length(F.replace(text, F.lit(sign), F.lit("")))
    lines, escaped = of("\n"), of('"') + of("\\") + of("\n") + of("\t") + of("\r")
    # of texts with other signs than ASCII: UTF-16 units beyond the characters, and characters beyond ASCII
    astral = F.when(octets == chars, 0).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int") - chars)
    wide = F.when(octets == chars, 0).otherwise(chars - F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]+", "")))
    return {
        "chars": chars,
        "utf8": octets,
        "utf16": chars + astral,
        "entities": chars + 4 * of("&") + 3 * (of("<") + of(">")) + 5 * of('"') + 4 * of("'"),
        "json": chars + escaped,
        "json_ascii": chars + escaped + 5 * wide + 6 * astral,
        "crlf": chars + lines,
        "crlf_utf8": octets + lines,
    }


def hidden_limits(texts: DataFrame) -> DataFrame:
    """(source, part, measure, limit_at, top, texts, piled): all lengths at which texts of a source pile up, in both
    tables together (part is empty) and in each table. Copies of a text count once; a source without a pile has no row.
    ``texts``: source, table_name, h (a hash of the text), tail (a hash of its end, null behind a final mark), lengths.

    At the greatest length of the tables together (top) all texts count, and of several measures the one with the
    largest pile is taken. At any other length only texts without a final mark count, and those of one length that
    end alike but for numbers count once: notes made after one pattern make no limit."""
    names = list(measures(F.lit("")))
    different = texts.groupBy("source", "h").agg(F.collect_set("table_name").alias("parts"), F.min("tail").alias("tail"), F.min("lengths").alias("lengths"))
    each = different.select("source", F.concat(F.array(F.lit("")), "parts").alias("parts"), "tail", F.posexplode("lengths").alias("rank", "len"))
    each = each.select("source", F.explode("parts").alias("part"), "tail", "rank", "len")
    at = ["source", "part", "rank", "len"]
    per = each.groupBy(*at).agg(F.count("*").alias("n"))
    ends = each.where("tail is not null").select(*at, "tail").distinct().groupBy(*at).agg(F.count("*").alias("o"))  # few texts have no mark
    per = per.join(ends, at, "left").fillna(0, ["o"])
    w = Window.partitionBy("source", "part", "rank")  # as many rows as there are different lengths
    near = lambda c, a, z: F.coalesce(F.sum(c).over(w.orderBy("len").rangeBetween(a, z)), F.lit(0))
    top = (F.col("part") == "") & (F.col("len") == F.max("len").over(w))
    per = per.withColumn("texts", F.sum("n").over(w)).withColumn("top", top)
    for c in "no":
        per = per.withColumn(f"piled_{c}", near(c, -SLACK, 0)).withColumn(f"below_{c}", near(c, -SLACK - BELOW, -SLACK - 1)).withColumn(f"above_{c}", near(c, 1, BELOW))
    pile = lambda c: (F.col(f"piled_{c}") >= PILE_TEXTS) & (F.col(f"piled_{c}") >= PILE_SHARE * F.col("texts")) & (F.col(f"piled_{c}") * BELOW >= PILE_DENSITY * (SLACK + 1) * F.greatest(f"below_{c}", f"above_{c}"))
    measure = F.get(F.array(*[F.lit(k) for k in names]), F.col("rank")).alias("measure")
    out = ["source", "part", measure, F.col("len").alias("limit_at"), "top", "texts"]
    best = Window.partitionBy("source").orderBy(F.desc("piled_n"), "rank")
    first = per.where(F.col("top") & pile("n")).withColumn("k", F.row_number().over(best)).where("k = 1").select(*out, F.col("piled_n").alias("piled"))
    return first.unionByName(per.where(~F.col("top") & pile("o")).select(*out, F.col("piled_o").alias("piled")))


# ---- endings -------------------------------------------------------------------------------------------------


def _word(w: str) -> str:
    if w.isdigit():
        return "0"
    m = _PATH.match(w)
    if m and m[1]:
        return "<path" + m[1] + ">"
    return w.lower()


_SPLIT = re.compile(f"({_TOKEN.pattern})", re.A)
_FOLLOWS = frozenset(".!?,;:)\n。，！？；）\"'”`（(")


def _kind(gap: str, last: bool) -> str:
    """'f' if a mark or line end follows a token, 'c' if the text goes on, 'e' at the end of the text. ``gap`` is all up to
    the next token."""
    head = gap[:3]
    if last or len(gap) > 2:
        if not head.strip():
            return "f" if "\n" in gap and last else "e" if last and not gap.strip() else "c"
    if head[:1] in _FOLLOWS and head or head[:2] in (" (", " （"):
        return "f"
    return "c"


class _Codes(dict):
    """Numbers of texts in the order in which they first occur."""

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self)
        return n


_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mix(tag: int, *parts: np.ndarray) -> np.ndarray:
    """64-bit keys of sequences of hashes, the tag being the kind of key."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), np.uint64(tag)) * _SALTS[0]
        for p, salt in zip(parts, _SALTS[1:]):
            h = (h ^ (p * salt)) * _SALTS[0]
            h ^= h >> np.uint64(29)
        return h


def _hash(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)


# Kinds of keys: one to three words, last letters of a word, the word before, four to two Chinese characters, labelled tails.
_W, _S, _P, _H, _T = (1, 2, 3), 4, 5, {4: 6, 3: 7, 2: 8}, 9
#: Bits of the bitmap of wanted keys, a power of two.
BITMAP_BITS = 1 << 23


def ending_keys(body: str) -> list[int]:
    """Keys of the ending of a text, the most specific first, then those for unknown words; 0 where there is none."""
    if not body:
        return []
    got = next(iter(_candidate_keys([pd.DataFrame({"h": [0], "size": [len(body)], "body": [body]})])))
    of = {level: int(np.array([key], np.int64).view(np.uint64)[0]) for level, key in zip(got.level, got.key) if level < 5}
    return [of.get(k, 0) for k in range(max(of, default=-1) + 1)]


def _han_keys(windows: np.ndarray, n: int) -> np.ndarray:
    packed = np.zeros(len(windows), np.uint64)
    for k in range(n):
        packed = (packed << np.uint64(16)) | windows[:, k]
    return _mix(_H[n], packed)


def _count_grams(bitmap: np.ndarray):
    """(key, ended, went_on) of the wanted keys over all texts, summed up within a batch."""

    def wanted(keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(BITMAP_BITS - 1)
        return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def words(bodies: list[str]):
        """(codes, ends, starts a text, hashes, names) of all tokens of the batch."""
        code, gap_code = _Codes(), _Codes()
        at, gaps, sizes, ends = [], [], [], []
        for body in bodies:
            part = _SPLIT.split(body)
            toks, between = part[1::2], part[2::2]
            at.extend(map(code.__getitem__, toks))
            gaps.extend(map(gap_code.__getitem__, between))
            sizes.append(len(toks))
            ends.append(between[-1] if between else "")
        size = np.array(sizes, np.int64)
        kind = np.array([_kind(g, False) for g in gap_code] or [""], "U1")[np.array(gaps, np.int64)]
        some = size > 0
        kind[np.cumsum(size)[some] - 1] = [_kind(g, True) for g, n in zip(ends, sizes) if n]
        names = [_word(w) for w in code]
        hashes = _hash(names)
        return np.array(at, np.int64), kind, size, hashes, names

    def run(batches):
        for pdf in batches:
            bodies = pdf.body.tolist()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def add(keys: np.ndarray, ended: np.ndarray, weight: np.ndarray | None = None) -> None:
                keep = wanted(keys)
                w = np.ones(len(keys), np.int64) if weight is None else weight
                found.append((keys[keep], np.where(ended, w, 0)[keep], np.where(ended, 0, w)[keep]))

            at, kind, sizes, hashes, names = words(bodies)
            if len(at):
                h = hashes[at]
                start = np.cumsum(sizes) - sizes
                pos = np.arange(len(at)) - np.repeat(start, sizes)
                real, ended = kind != "e", kind == "f"
                add(_mix(_W[0], h[real]), ended[real])
                two, three = np.flatnonzero(real & (pos > 0)), np.flatnonzero(real & (pos > 1))
                add(_mix(_W[1], h[two - 1], h[two]), ended[two])
                add(_mix(_P, h[two - 1]), ended[two])
                add(_mix(_W[2], h[three - 2], h[three - 1], h[three]), ended[three])
                # last letters of the words, against the same letters within words
                often = np.bincount(at[real], minlength=len(names))
                s_end: Counter[str] = Counter()
                s_in: Counter[str] = Counter()
                for w, times in zip(names, often.tolist()):
                    if times and w[0] != "<":
                        s_end[w[-3:]] += times
                        for j in range(len(w) - 3):
                            s_in[w[j : j + 3]] += times
                for c, flag in ((s_end, True), (s_in, False)):
                    if c:
                        add(_mix(_S, _hash(list(c))), np.full(len(c), flag), np.array(list(c.values()), np.int64))
            # Chinese: windows of two to four characters that end within a run or at its end, not at the end of the text
            joined = "\n".join(bodies) + "\n"
            chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            han = ((chars >= 0x3400) & (chars <= 0x9FFF)) | ((chars >= 0xF900) & (chars <= 0xFAFF))
            if han.any():
                ends_text = np.zeros(len(chars), bool)
                ends_text[np.cumsum([len(b) + 1 for b in bodies]) - 1] = True  # the line end behind each text
                run_length = np.arange(len(chars)) - np.maximum.accumulate(np.where(han, -1, np.arange(len(chars))))
                last = np.flatnonzero(han & ~np.append(ends_text[1:], True))
                mark = np.zeros(len(chars), bool)
                after = last + 1
                off = after[~han[after]]
                mark[off] = [not joined[k].isalnum() for k in off]
                for n in (2, 3, 4):
                    p = last[run_length[last] >= n]
                    windows = np.stack([chars[p - n + 1 + k] for k in range(n)], axis=1).astype(np.uint64)
                    add(_han_keys(windows, n), mark[p + 1])
            # labelled tails: whole at the end of a text, or the beginning of a longer one anywhere
            whole, begins = [], []
            for body in bodies:
                if ": " in body:
                    m = _LABEL.search(body)
                    if m:
                        whole.append(m[1])
                    for m in _LABELLED.finditer(body):
                        a = m[1].index(": ") + 3
                        begins += [m[1][:k] for k in range(a, len(m[1]))]
            for c, flag in ((Counter(whole), True), (Counter(begins), False)):
                if c:
                    add(_mix(_T, _hash(list(c))), np.full(len(c), flag), np.array(list(c.values()), np.int64))
            keys = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            if not len(keys):
                continue
            unique, back = np.unique(keys, return_inverse=True)
            sums = [np.bincount(back, weights=np.concatenate([f[k] for f in found]), minlength=len(unique)).astype(np.int64) for k in (1, 2)]
            yield pd.DataFrame({"key": unique.view(np.int64), "ended": sums[0], "went_on": sums[1]})

    return run


def _candidate_keys(batches):
    for pdf in batches:
        h, size, bodies = pdf.h.to_numpy(np.int64), pdf["size"].to_numpy(np.int64), pdf.body.tolist()
        rows: list[tuple[np.ndarray, int, np.ndarray]] = []  # indexes of texts, level, keys
        chinese = np.array([_CJK.match(b[-1:]) is not None for b in bodies], bool)
        words = [[] if c else [_word(w) for w in _TOKEN.findall(b[-400:])][-3:] for b, c in zip(bodies, chinese)]
        code: dict[str, int] = {"": 0}
        # the last three words of each text, the last one first; its last letters; '' where there is none
        last = np.array([[code.setdefault(w, len(code)) for w in (*reversed(t), "", "", "")[:3]] for t in words], np.int64).reshape(-1, 3)
        ends = np.array([code.setdefault(t[-1][-3:] if t else "", len(code)) for t in words], np.int64)
        n = np.array([len(t) for t in words], np.int64)
        hashes = _hash(list(code))
        w1, w2, w3 = (hashes[last[:, k]] for k in range(3))
        for level, least, keys in ((0, 3, _mix(_W[2], w3, w2, w1)), (1, 2, _mix(_W[1], w2, w1)), (2, 1, _mix(_W[0], w1)), (3, 1, _mix(_S, hashes[ends])), (4, 1, _mix(_P, w2))):
            i = np.flatnonzero(n >= least)
            rows.append((i, level, keys[i]))
        for level, k in ((0, 4), (1, 3), (2, 2)):
            i = np.flatnonzero(chinese & np.array([len(b) >= k for b in bodies], bool))
            if len(i):
                signs = np.array([[ord(c) for c in bodies[j][-k:]] for j in i], np.uint64)
                rows.append((i, level, _han_keys(signs, k)))
        rows.append((np.flatnonzero(chinese), 8, np.zeros(int(chinese.sum()), np.uint64)))
        tails = [(j, m[1]) for j, b in enumerate(bodies) if ": " in b and (m := _LABEL.search(b))]
        if tails:
            rows.append((np.array([j for j, _ in tails]), 9, _mix(_T, _hash([t for _, t in tails]))))
        i = np.concatenate([r[0] for r in rows]).astype(np.int64)
        keys = np.concatenate([r[2] for r in rows])
        yield pd.DataFrame({"h": h[i], "size": size[i], "level": np.repeat([r[1] for r in rows], [len(r[0]) for r in rows]).astype(np.int32), "key": keys.view(np.int64)})


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of all keys; the driver gets its BITMAP_BITS / 64 words, whatever the number of keys."""
    bit = keys.select(F.pmod("key", F.lit(BITMAP_BITS)).alias("b")).distinct()
    words = bit.groupBy(F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in words:
        out[r.w] = r.v
    return out.view(np.uint64)


def can_end(texts: DataFrame, ask: DataFrame) -> DataFrame:
    """(h, size, can_end) of the texts (h, size, body) of ``ask``: whether their last words can end a text, by how all
    ``texts`` (body, each different one once) go on behind the same words."""
    seen = cut(ask.mapInPandas(_candidate_keys, "h long, size int, level int, key long"))
    wanted = _bitmap(seen)
    counts = texts.select("body").mapInPandas(_count_grams(wanted), "key long, ended long, went_on long").groupBy("key").agg(F.sum("ended").alias("f"), F.sum("went_on").alias("c"))
    known = seen.join(counts, "key", "left").fillna(0, ["f", "c"])
    at = lambda level, col: F.coalesce(F.max(F.when(F.col("level") == level, F.col(col))), F.lit(0))
    s = known.groupBy("h", "size").agg(*[at(k, c).alias(f"{c}{k}") for k in (0, 1, 2, 3, 4, 9) for c in "fc"], F.max(F.col("level") == 8).alias("han"))
    both = lambda k: F.col(f"f{k}") + F.col(f"c{k}")
    ratio = lambda k: F.col(f"f{k}") / F.greatest(both(k), F.lit(1))
    share = (
        F.when(both(0) >= 3, ratio(0)).when(both(1) >= 3, ratio(1)).when(both(2) >= 3, ratio(2)).when(F.col("han"), F.lit(0.0))
        .when((both(2) >= 1) | (ratio(3) >= 0.6), ratio(4)).otherwise(0.0)
    )
    tail = (F.col("f9") >= TAIL_TEXTS) & (ratio(9) >= TAIL_SHARE)
    return s.select("h", "size", ((share >= CAN_END) | tail).alias("can_end"))


def truncated(texts: DataFrame) -> DataFrame:
    """One row per text of (table_name, record_id, source, text) that is not null or blank: those three columns,
    is_cut, and the evidence: marker, at_limit, measure, limit_at, can_end.

    A text is cut if it does not end on a final mark or closing bracket and (a) a marker of a break follows, or (b) its
    length is a hidden limit of its source, or (c) its ending cannot end a sentence: an open bracket, a comma, an unfinished
    word or path, or words that go on wherever else they occur. Null, empty and blank texts give no row. Repeated rows
    are judged each for itself, by their text, whatever their ids (which may repeat or be null). A null source is a
    source of its own. An empty table gives an empty result.
    """
    t = texts.where("text is not null").select(
        "table_name", F.col("record_id").cast("long").alias("record_id"), F.coalesce("source", F.lit("")).alias("source"), "text"
    )
    t = t.withColumn("stripped", F.when(may_be_marked(F.col("text")), F.regexp_replace("text", MARKERS, "")).otherwise(F.col("text")))
    t = t.withColumn("marker", F.char_length("stripped") < F.char_length(F.rtrim("text")))
    t = t.withColumn("broken", F.col("text").contains("�") & F.col("text").rlike(r"�\W*$")).withColumn("body", F.rtrim("stripped", F.lit(BLANKS)))
    body = F.col("body")
    marked, path, tail = is_final(body), on_path(body), F.right(body, F.lit(64))
    opened = tail.rlike(r"[(（\[][^)）\]\n]{0,60}$") | tail.contains("`") & tail.rlike(r"(?:^|[^`])`[^`\n]{1,60}$") & (F.regexp_count("body", F.lit("`")) % 2 == 1)
    # everything that is read off a text is read once
    t = cut(
        t.where("body <> ''").select(
            "table_name", "record_id", "source", "marker", "broken", "body", F.xxhash64("body").alias("h"), F.char_length("body").alias("size"),
            F.when(~marked, F.xxhash64(F.right(F.regexp_replace("body", r"[0-9]+", "0"), F.lit(12)))).alias("tail"), (marked & ~path).alias("final"),
            (opened | _last(body).isin(*",，、;；:：/-") | path).alias("broken_off"), F.array(*[v.cast("int") for v in measures(body).values()]).alias("lengths"),
        )
    )
    limit = F.struct(~F.col("top"), -F.col("piled"), *[F.col(c) for c in ("part", "measure", "limit_at", "top")])
    of_source = lambda df, x: df.groupBy("source").agg(F.sort_array(F.collect_list(x)).alias("limits"))
    names = F.array(*[F.lit(k) for k in measures(F.lit(""))])

    def reached(x: Column) -> Column:
        length, here = F.get("lengths", F.array_position(names, x["measure"]).cast("int") - 1), (x["part"] == "") | (x["part"] == F.col("table_name"))
        return here & (length >= x["limit_at"] - SLACK) & (x["top"] | (length <= x["limit_at"]))

    # One pile shows in several measures and at lengths close by: a limit must have texts that no larger pile has.
    hits = F.filter("limits", reached)
    every = t.where(F.col("tail").isNotNull()).select("source", "table_name", "h", "lengths").join(of_source(hidden_limits(t), limit), "source")
    every = every.select("source", "h", F.posexplode(hits).alias("k", "x"))
    own = every.groupBy("source", "x").agg(F.count_distinct("h").alias("n"), F.count_distinct(F.when(F.col("k") == 0, F.col("h"))).alias("own"))
    own = own.where(F.col("x.top") | (F.col("own") >= PILE_TEXTS) & (F.col("own") * 2 >= F.col("n")))
    limits = cut(of_source(own, F.col("x")))
    t2 = t.join(limits, "source", "left")
    t2 = t2.withColumn("hit", F.get(hits, F.lit(0))).withColumn("at_limit", F.col("hit").isNotNull())
    shown = F.coalesce("hit", F.get("limits", F.lit(0)))
    t2 = t2.withColumn("measure", shown["measure"]).withColumn("limit_at", shown["limit_at"])
    ask = t2.where("not final and not broken_off and not marker and not at_limit and not broken").select("h", "size", "body").dropDuplicates(["h", "size"])
    different = t.groupBy("h", "size").agg(F.min("body").alias("body"))
    r = t2.drop("body", "lengths", "limits", "hit", "tail").join(can_end(different, ask), ["h", "size"], "left")
    is_cut = F.col("broken") | (~F.col("final") & (F.col("marker") | F.col("at_limit") | F.col("broken_off") | ~F.coalesce("can_end", F.lit(True))))
    return r.select(
        "table_name", "record_id", F.nullif("source", F.lit("")).alias("source"), is_cut.alias("is_cut"), "marker", "at_limit", "measure", "limit_at", "can_end"
    )


def truncation_report(found: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, the greatest hidden limit if the source has one, and all its limits."""
    limit = F.struct("limit_at", "measure")
    r = found.groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if("is_cut").alias("cut_texts"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("cut_share"),
        F.max(F.when(F.col("limit_at").isNotNull(), limit)).alias("m"), F.sort_array(F.collect_set(F.when(F.col("at_limit"), limit))).alias("limits"),
    )
    return r.select("source", "texts", "cut_texts", "cut_share", "m.measure", "m.limit_at", "limits")
