"""Problem 9: keyword-stuffed and link-list pages.

A page is spam if more than half of its lines are repeated keywords, links, menu paths or product tags. Links,
paths and tags show in the form of a line. Repeated keywords show in the order of the words of the whole page:

* the gaps after which a term recurs: a phrase that comes back every few words is unnaturally regular,
* the autocorrelation of the word sequence over lags of a few words, taken in a window around each line,
* lists of nouns without function words, all of whose words recur on the page at short gaps.

Lists that a newspaper prints for its readers (prices, ships, prizes, contents, notices) have function words,
figures, leaders or names that do not come back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the four languages of the collection; the weak ones also join nouns.
STRONG = frozenset(
    "the a an and or to from at by with for on in into upon was were has have had is are be been it its that this "
    "which who as but not than then so no under over out after before when while until all "
    "le la les des un une et dans sur pour par avec qui que est aux au sans sous comme lors mais ou "
    "el los las y una con para del se su al lo sin por como pero tras "
    "der die das und den dem des ein eine einen zu mit auf von im am wurde wird ist nicht auch als bei nach über "
    "aber ohne aus vor wie gegen".split()
)
# Fixed value: prepositions that only join a product to a place.
JOINS = frozenset(("in", "at", "en", "aus"))
# Fixed value: letters that scans confuse, folded to one.
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "f": "s", "c": "e", "q": "g", "a": "o", "u": "n", "h": "b"})

_WORD = re.compile(r"[^\W_]+")
# Endings of host names; those of two letters that are words as well need a hyphen, a path or a line end.
_ENDINGS = "com|net|org|info|biz|edu|gov|mil|name|shop|store|online|site|web|app|dev|co|io|tv|eu|uk|fr|nl|pl|cz|dk|se|ru|cn|jp|br|mx|invalid|example|test"
# each form begins at its dot or hyphen, so that a page is searched in one pass
_HOST = rf"(?<=[a-z0-9])\.(?:{_ENDINGS})\b(?!\.\s)|(?<=[a-z0-9])-[a-z0-9]+\.[a-z]{{2}}(?![^\W_]|\.\w)|(?<=[a-z0-9-]{{2}})\.[a-z]{{2,3}}/\w"
_LINK = re.compile(_HOST + r"|\w{3,5}\s?[:;]\s?//|www\s?[.,]|\w[\w-]*\.(?:\w[\w-]*\.)*(?:co|com|net|org|invalid|inval\w+|exa\w+|[tf]est)\b(?!\.\s)|\.php|\w+\.[\w-]+\.\w{3,}|[?&]?\bid=\d", re.I)
_PATH_END = re.compile(r"[a-z]/\d|/\s*$|[-\w]+/[-\w]+/|[-a-z]+/[-a-z]+-")
_MENU = re.compile(r"\s(?:>+|»|›|→|::|\||/|·|•|\*|~|=>|->|\\)(?=\s|$)")
_TAG = re.compile(r"(?:^|[\s,;\]])(?:[#+@*]|ta[gq]:)[^\W\d]\w*|\[\s?[^\W\d][\w -]*\]", re.I)
_PART = re.compile(r"\b(?:[a-z]{2,4}|[A-Z]{2,4})[-.]?\d{4,}\b")
_DOTTED, _NAMED_TAG, _FIGURES = re.compile(r"\.[^\W_][^\W_]"), re.compile(r":[^\W\d]"), re.compile(r"\d{4}")
_LEADER = re.compile(r"\.\s?\.\s?\.")

#: Lags of the autocorrelation (also the reach of its window), least share of matching words in a window.
LAGS, MATCH = 12, 0.34
#: A phrase is unnaturally regular if it recurs at least so often with a median gap of at most so many words.
PHRASE_TIMES, PHRASE_GAP = 4, 8
#: In noun lists: least share of words that recur, and the longest median gap at which they do; and the gap of
#: words that recur so closely that function words between them excuse nothing.
RECUR_SHARE, RECUR_GAP, CLOSE_SHARE, CLOSE_GAP = 0.5, 60, 0.45, 16
#: A single term that recurs so often at such a median gap marks every line it is in.
TERM_TIMES, TERM_GAP = 5, 7


def fold(word: str) -> str:
    w = word.lower().replace("rn", "m").replace("cl", "d").replace("vv", "w")
    return w.translate(_FOLD)


def is_strong(word: str) -> bool:
    w = word.lower()
    if w in STRONG:
        return True
    w = w.replace("0", "o").replace("1", "l").replace("rn", "m").replace("vv", "w")
    return w in STRONG or (len(w) > 2 and w.replace("c", "e").replace("b", "h") in STRONG)


class _Words:
    """What is known of each spelling: folded form, function word, figures, length, case."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.folds: dict[str, int] = {}
        self.rows: list[tuple[int, bool, bool, bool, bool]] = []
        self.table = np.zeros((0, 5), np.int64)

    def codes(self, words: list[str]) -> list[int]:
        get = self.code.get
        out = [get(w, -1) for w in words]
        for k, c in enumerate(out):
            if c < 0:
                w = words[k]
                c = get(w)
                if c is None:
                    f = fold(w)
                    c = self.code[w] = len(self.rows)
                    self.rows.append((self.folds.setdefault(f, len(self.folds)), is_strong(w), any(ch.isdigit() for ch in w), len(f) > 2, w[0].islower() or w.isupper()))
                out[k] = c
        return out

    def attributes(self) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, np.int64).reshape(-1, 5)
        return self.table


def _medians(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Upper median of the values of each owner 0..n-1; infinite where it has none."""
    out = np.full(n, np.inf)
    if len(owner):
        by = np.lexsort((value, owner))
        owner, value = owner[by], value[by]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ends = np.append(starts[1:], len(owner))
        out[owner[starts]] = value[(starts + ends) // 2]
    return out


def _gaps(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, gap) for each recurrence: ids of the items at the ascending positions ``at``."""
    order = np.argsort(ids, kind="stable")
    i, p = ids[order], at[order]
    same = i[1:] == i[:-1]
    return i[1:][same], (p[1:] - p[:-1])[same]


def _tests(t: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether a text may hold links, menus, tags, part numbers, leaders: plain searches before the patterns."""
    link = ("//" in t or "www" in t or "WWW" in t or "id=" in t or _DOTTED.search(t) is not None) and _LINK.search(t) is not None
    menu = any(c in t for c in ">»›→|/•·*~=\\") or "::" in t
    tag = any(c in t for c in "#+@*[") or _NAMED_TAG.search(t) is not None
    return link, menu, tag, _FIGURES.search(t) is not None, ".." in t or ". ." in t


def flag_pages(texts: list[str], known: _Words | None = None) -> list[list[tuple[str, str]]]:
    """Per text its lines that are not blank, each with its kind of spam or ''. Texts are judged one by one;
    they are handled together only to use whole arrays."""
    known = known or _Words()
    lines: list[str] = []
    bounds = [0]
    words: list[str] = []
    n_words: list[int] = []
    tests: list[tuple[bool, bool, bool, bool, bool]] = []
    for t in texts:
        tests.append(_tests(t))
        for x in t.split("\n"):
            if x.strip():
                lines.append(x)
                w = _WORD.findall(x)
                words += w
                n_words.append(len(w))
        bounds.append(len(lines))
    n_lines, n = len(lines), len(words)
    per_line = np.array(n_words, np.int64)
    edges = np.concatenate([[0], np.cumsum(per_line)])
    line_of = np.repeat(np.arange(n_lines), per_line)
    doc_of_line = np.repeat(np.arange(len(texts)), np.diff(bounds))
    doc = doc_of_line[line_of] if n else np.zeros(0, np.int64)
    codes = np.array(known.codes(words), np.int64)
    info = known.attributes()[codes] if n else np.zeros((0, 5), np.int64)
    strong, figure, long, small = (info[:, k].astype(bool) for k in range(1, 5))
    content = ~strong & ~figure & long
    place = np.arange(n) - edges[line_of] if n else np.zeros(0, np.int64)
    _, ids = np.unique(doc * (len(known.folds) + 1) + info[:, 0], return_inverse=True)
    terms = int(ids.max()) + 1 if n else 0
    count = np.bincount(ids, minlength=terms)
    # share of a term's occurrences that stand at its usual place in the line
    fixed = np.zeros(terms)
    if n:
        wide = int(place.max()) + 1
        where, times = np.unique(ids * wide + place, return_counts=True)
        np.maximum.at(fixed, where // wide, times)
        fixed /= count
    gap = _medians(*_gaps(ids, np.arange(n)), terms)
    joins = np.zeros(n, bool)
    for w in JOINS:
        for v in (w, w.upper(), w.title()):
            if v in known.code:
                joins |= codes == known.code[v]
    # terms that nearly always stand before a function word belong to a form of words ("apply to")
    formal = np.zeros(terms)
    if n > 1:
        before = strong[1:] & ~joins[1:] & (doc[1:] == doc[:-1])
        formal = np.bincount(ids[:-1][before], minlength=terms) / count
    free = (fixed < 0.7) & (formal < 0.8)
    recurs = (count >= 2) & (gap <= RECUR_GAP)
    close = (count >= 3) & (gap <= CLOSE_GAP) & free
    heavy = (count >= TERM_TIMES) & (gap <= TERM_GAP) & free
    # regular phrases: pairs of neighbouring words, one of them content, none a strong function word
    regular = np.zeros(n, bool)
    if n > 1:
        ok = ~strong[1:] & ~strong[:-1] & (content[1:] | content[:-1]) & ~figure[1:] & ~figure[:-1] & (doc[1:] == doc[:-1]) & free[ids[:-1]]
        at = np.flatnonzero(ok)
        if len(at):
            _, pair, times = np.unique(ids[at] * terms + ids[at + 1], return_inverse=True, return_counts=True)
            steady = (times >= PHRASE_TIMES) & (_medians(*_gaps(pair, at), len(times)) <= PHRASE_GAP)
            hit = at[steady[pair]]
            regular[hit] = True
            regular[hit + 1] = True
    # autocorrelation: the largest share, over the lags, of content words near a word that equal the word so
    # many places before. Words that begin one line as they began the other do not count: forms and tables of
    # a newspaper repeat in that way.
    acf = np.zeros(n)
    if n:
        first = np.searchsorted(doc, np.arange(len(texts)))
        last = np.searchsorted(doc, np.arange(len(texts)), side="right")
        lo, hi = np.maximum(np.arange(n) - LAGS, first[doc]), np.minimum(np.arange(n) + LAGS + 1, last[doc])
        for lag in range(1, min(LAGS, n - 1) + 1):
            total = np.zeros(n + 1)
            total[lag + 1 :] = np.cumsum((ids[lag:] == ids[:-lag]) & content[lag:] & ((place[lag:] > 1) | (place[lag:] != place[:-lag])))
            np.maximum(acf, (total[hi] - total[lo]) / (hi - lo), out=acf)
    per = lambda x: np.bincount(line_of, weights=x, minlength=n_lines) if n else np.zeros(n_lines)
    some = np.maximum(per_line, 1)
    own = np.maximum(per(content), 1)
    has_own = per(content) > 0
    no_strong = per(strong) == 0
    only_joins = per(strong & ~joins) == 0
    l_figure, l_regular, l_acf = per(figure) / some, per(regular) / some, per(acf) / some
    l_heavy = per(heavy[ids] & content) > 0
    l_close = per(close[ids] & content) / some
    l_back = per(recurs[ids] & content) / own
    l_near = per((close | (recurs & (gap <= 40)))[ids] & content) / own
    l_free = per(free[ids] & content) / own
    l_small = per(small & content) / own
    kinds = [""] * n_lines
    lists = np.zeros(n_lines, bool)
    noun = (per_line > 1) & only_joins & has_own
    dense = ((l_regular >= 0.3) & (l_acf >= MATCH / 2)) | (l_acf >= MATCH) | l_heavy | ((per_line > 1) & (l_close >= CLOSE_SHARE))
    for k, line in enumerate(lines):
        link, menu, tag, part, leader = tests[doc_of_line[k]]
        m = per_line[k]
        if link and _LINK.search(line):
            kinds[k] = "link"
            continue
        if link and k and doc_of_line[k - 1] == doc_of_line[k] and kinds[k - 1] == "link" and no_strong[k] and m <= 5 and (_PATH_END.search(line) or line.rstrip().endswith("|")):
            kinds[k] = "link"
            continue
        if leader and _LEADER.search(line):
            continue
        if menu:
            marks = len(_MENU.findall(line))
            if marks and (no_strong[k] or marks >= 2):
                kinds[k] = "menu"
                continue
        if tag and m and len(_TAG.findall(line)) >= 0.15 * m:
            kinds[k] = "tag"
            continue
        if part and no_strong[k] and _PART.search(line):
            kinds[k] = "tag"
            continue
        if not m or l_figure[k] >= 0.3:
            continue
        if dense[k]:
            kinds[k] = "keyword"
        elif noun[k]:
            lists[k] = l_small[k] >= 0.6 and ":" not in line
            back = l_back[k]
            if not no_strong[k]:
                lists[k] = lists[k] and line[:1].islower()
                back = l_near[k] if l_small[k] >= 0.4 and "." not in line else 0
            if back >= RECUR_SHARE and l_free[k] >= 0.5:
                kinds[k] = "keyword"
    out = []
    for d in range(len(texts)):
        a, z = bounds[d], bounds[d + 1]
        part_kinds = kinds[a:z]
        # lists of different nouns: lines without function words beside lines that are spam
        for k in np.flatnonzero(lists[a:z]):
            near = part_kinds[max(0, k - 2) : k] + part_kinds[k + 1 : k + 3]
            if not part_kinds[k] and sum(x != "" for x in near) >= 2:
                part_kinds[k] = "keyword"
        # a line of one or two words between spam lines belongs to them (wrapped terms)
        for k in range(z - a):
            if not part_kinds[k] and per_line[a + k] <= 2 and k and part_kinds[k - 1] and (k + 1 == z - a or part_kinds[k + 1]):
                part_kinds[k] = part_kinds[k - 1]
        out.append(list(zip(lines[a:z], part_kinds)))
    return out


#: Texts that are handled together, by characters.
BATCH_CHARS = 1_000_000


def score_texts(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """(lines, spam lines, most frequent kind) per text."""
    out: list[tuple[int, int, str]] = []
    known, batch, size = _Words(), [], 0

    def flush() -> None:
        nonlocal known, batch, size
        for page in flag_pages(batch, known):
            spam = [k for _, k in page if k]
            out.append((len(page), len(spam), max(sorted(set(spam)), key=spam.count) if spam else ""))
        batch, size = [], 0
        if len(known.rows) > 400_000:
            known = _Words()

    for t in texts:
        batch.append(t or "")
        size += len(batch[-1])
        if size >= BATCH_CHARS:
            flush()
    flush()
    return out


_SCHEMA = "doc_id long, n_lines int, n_spam int, kind string"


def _score(batches):
    for b in batches:
        got = score_texts(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([g[k] for g in got], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.string())))],
            names=["doc_id", "n_lines", "n_spam", "kind"],
        )


def score_pages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_spam, kind for every row; a null, empty or blank text has no lines.

    Rows are judged one by one over their whole text: repeated rows, extra columns and order do not matter,
    null ids stay null, an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score, _SCHEMA)


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return score_pages(docs, id_col, text).where("n_spam * 2 > n_lines")
