"""Evaluation passages inside a training corpus, whole or in part, however they are dressed up.

A document gives an item away when it holds at least ``MIN_WORDS`` consecutive words of the passage (or all of a shorter one) with at
most one word in ten replaced, dropped or added, the first and the last ones included. A part of twice MIN_WORDS or more can be cut in
two of which one has no more edits for its length, so parts of up to 39 words with 3 edits decide. Any of them keeps a run of ``RUN``
consecutive words intact: m words with e edits leave at least (m - e) / (e + 1) in a row, which is least for 20 words with 2 edits.
So the SimHash windows are RUN words wide: a window of that part has the very fingerprint of an item's window, and the search misses
nothing. Windows of the size of an item miss parts, as measured on 400 parts of 20 words with 2 words replaced, planted in documents: at
radius 3, 6, 9 and 12 windows of 20 words find 3, 23, 71 and 97 % of them, windows as long as the passage 0, 0, 0 and 1 %. Against that,
equal windows of RUN words find all; the Hamming radius only adds pairs, which the similarity then refuses. Only passages of 10 or 11 words with an edit in the middle (5 words in a row are left) and those of fewer than RUN words need
less; they are searched by exact windows of 5 words and of the whole passage.

One pass over the corpus, no shuffle, nothing of the corpus is gathered:

1. screen: only documents with RUN tokens in a row (fewer if an item asks for it) that occur in some item, in any spelling of them, can
   hold such a part;
2. SimHash of every window of RUN words of the rest; multi-index Hamming search: within RADIUS = 3 bits at least one of four 16-bit
   blocks is equal, so four tables of blocks find every item window within the radius;
3. weighted-shingle similarity of the window pair, then alignment of the passage from the hits to both sides.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, EDIT_SHARE = 20, 10
RUN, RADIUS, BLOCKS = 6, 3, 4
#: Edits that the longest part which must be looked at may have.
EDITS = (2 * MIN_WORDS - 1) // EDIT_SHARE
SIMILAR = 0.8
#: Words of a document that are fingerprinted at a time.
STRETCH = 1 << 16
#: Items searched for in one pass over the corpus; more take further passes.
ITEMS_PER_PASS = 20_000

# fixed values: letters without a canonical decomposition
FOLD = str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i"})
#: characters that end a word although they aren't ASCII, and ASCII that joins or ends one
GAPS = {c: " " for c in "–—―‒−•·…  \u0085 　"}
_LOW = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAG = re.compile(r"<(/?)(\w*)[^<>]*>")
_MOJI = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_ESC = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt])|\\(.)")
_QP = re.compile(r"(?:=[0-9A-F]{2})+|(?:%[0-9A-Fa-f]{2})+")
_DIGITS = re.compile(r"(?<=\d)[,.'’_  ](?=\d)")
_BREAK = re.compile(r"[-‐­=][ \t]*\r?\n[>|#*\s]*")
_LINK = re.compile(r"\]\([^()\s]*\)")
_INLINE = {"b", "i", "em", "strong", "span", "a", "u", "code", "mark", "small", "sup", "sub", "wbr", "font"}


def _bare(t: str) -> str:
    """Without tags and link targets; tags that may stand inside a word leave nothing."""
    if "<" in t:
        t = _TAG.sub(lambda m: "" if m.group(2).lower() in _INLINE else " ", t)
    return _LINK.sub("]", t) if "](" in t else t


def _unmojibake(m: re.Match) -> str:
    s = m.group(0)
    for enc in ("cp1252", "latin-1"):
        for n in range(len(s), 1, -1):
            try:
                return s[:n].encode(enc).decode("utf-8") + s[n:]
            except UnicodeError:
                continue
    return s


def _escaped(m: re.Match) -> str:
    u, x, c, other = m.groups()
    return chr(int(u or x, 16)) if u or x else " " if c else other


def _quoted_bytes(m: re.Match) -> str:
    raw = bytes.fromhex(re.sub("[=%]", "", m.group(0)))
    try:
        return raw.decode("utf-8")
    except UnicodeError:
        return raw.decode("latin-1")


def words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation, markup, escapes and line breaks inside words."""
    t = text
    if "\\" in t:
        t = _ESC.sub(_escaped, t)
    for _ in range(2):
        if "&" in t:
            t = html.unescape(t)
    t = _BREAK.sub("", _bare(t))
    if "=" in t or "%" in t:
        t = _QP.sub(_quoted_bytes, t)
    if not t.isascii():
        t = _MOJI.sub(_unmojibake, t)
        for c, gap in GAPS.items():
            t = t.replace(c, gap)
        t = unicodedata.normalize("NFKD", t.translate(FOLD))
    t = _DIGITS.sub("", t)
    raw = t.encode("ascii", "ignore").replace(b"'", b"").replace(b"`", b"").replace(b"*", b"").replace(b"_", b"").replace(b"~", b"")
    return raw.translate(_LOW).decode().split()


def _cheap(t: str) -> list[bytes]:
    """The screen's tokens: some spellings stay in pieces, but the pieces of all spellings of an item's word are known."""
    if "&" in t:
        t = html.unescape(t)
    t = _bare(t)
    if "-" in t or "=\n" in t or "­" in t or "‐" in t:
        t = _BREAK.sub("", t)
    if not t.isascii():
        for c in GAPS:
            if c in t:
                t = t.replace(c, " ")
        t = unicodedata.normalize("NFKD", t)
    return t.encode("ascii", "ignore").translate(_LOW).split()


def _spellings(w: str) -> list[str]:
    """Ways in which a word of an item may stand in a text as far as the screen's tokens differ."""
    plain = unicodedata.normalize("NFKD", w.translate(FOLD)).encode("ascii", "ignore").decode()
    utf = w.encode("utf-8")
    forms = [w, plain, plain.replace("'", "").replace(",", ""), re.sub("['’,.]", "", w), re.sub("['’,.]", " ", w), re.sub("['’,.]", " ", plain)]
    if not w.isascii():
        moji = [utf.decode("cp1252", "replace"), utf.decode("latin-1")]
        byte = ["".join(chr(b) if b < 128 else f"{mark}{b:02X}" for b in utf) for mark in ("=", "%", "\\x")]
        forms += [w.encode("ascii", "ignore").decode(), *moji, *byte, w.encode("ascii", "xmlcharrefreplace").decode().replace("&", " "), w.encode("ascii", "replace").decode()]
        forms += ["".join(c if c.isascii() else f"\\u{ord(c):04x}" for c in w), "".join(c if c.isascii() else f"\\u{ord(c):04X}" for c in w)]
    return forms + [f"n{f}" for f in forms] + [f"t{f}" for f in forms] + [f"u201c{f}" for f in forms] + [f"{f}u201d" for f in forms]


#: what markup and escapes may leave between two words of an item
_BETWEEN = b"br p a b i u em strong span div li ul td tr href n r t s x amp quot nbsp ldquo rdquo lsquo rsquo hellip mdash ndash code u201c u201d u2019 u2018 e2 80 9c 9d 99 98 c2 a0 201c 201d 2019 8220 8221 8217 39 34 x27 x2019 gt lt 3d 20 2c 22 html body"


class Items:
    """What every task needs to know about the items of a pass."""

    def __init__(self, rows: list[tuple[int, str]]):
        by_words: dict[tuple, list[int]] = {}
        vocab = set(_BETWEEN.split())
        for item, passage in rows:
            w = tuple(words(passage or ""))
            if w:
                by_words.setdefault(w, []).append(item)
                for raw in (passage or "").split():
                    for form in _spellings(raw):
                        vocab.update(_cheap(form))
            for token in w:
                vocab.add(token.encode())
        self.flag = dict.fromkeys(vocab, b"1")
        self.items = list(by_words.values())
        self.passages = list(by_words)
        self.code = {w: k for k, w in enumerate(sorted({x for p in by_words for x in p}))}
        self.coded = [np.array([self.code[x] for x in p]) for p in self.passages]
        self.short: dict[int, dict[tuple, list[tuple[int, int]]]] = {}  # by width: exact windows of passages in which RUN words in a row may be missing
        for p, c in enumerate(self.coded):
            width = _width(len(c))
            for i in range(len(c) - width + 1 if width < RUN else 0):
                self.short.setdefault(width, {}).setdefault(tuple(c[i : i + width].tolist()), []).append((p, i))
        self.least = min([RUN, *self.short])
        held = np.bincount(np.concatenate([np.unique(c) for c in self.coded]) if self.coded else np.zeros(0, int), minlength=len(self.code) + 1)
        self.weight = np.log1p(len(self.coded) / np.maximum(1, held))  # words of few items weigh most
        rng = np.random.default_rng(11)
        self.planes = rng.choice(np.array([-1, 1], np.int8), size=(len(self.code) + 1, 64))  # the last row: any other word
        self.pair_planes = rng.choice(np.array([-1, 1], np.int8), size=(4096, 64))
        prints = [self.prints(c) for c in self.coded]
        self.owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        self.at = np.concatenate([np.arange(len(p)) for p in prints]) if prints else np.zeros(0, int)
        self.print = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.order, self.sorted = [], []
        for b in range(BLOCKS):
            block = (self.print >> np.uint64(16 * b)).astype(np.uint16)
            o = np.argsort(block, kind="stable")
            self.order.append(o)
            self.sorted.append(block[o])

    def prints(self, code: np.ndarray) -> np.ndarray:
        """SimHashes of all windows of RUN words; features are the words and their adjacent pairs, so order counts."""
        if len(code) < RUN:
            return np.zeros(0, np.uint64)
        zero = np.zeros((1, 64), np.int32)
        one = np.concatenate([zero, np.cumsum(self.planes[code], axis=0, dtype=np.int32)])
        pair = (code[:-1] * 31 + code[1:] * 17) % 4096
        two = np.concatenate([zero, np.cumsum(self.pair_planes[pair], axis=0, dtype=np.int32)])
        s = one[RUN:] - one[:-RUN] + two[RUN - 1 :] - two[: -(RUN - 1)]
        return np.packbits(s > 0, axis=1, bitorder="little").view(np.uint64).ravel()

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) pairs within RADIUS bits, by multi-index search."""
        left, right = [], []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(16 * b)).astype(np.uint16)
            lo, hi = np.searchsorted(self.sorted[b], block, "left"), np.searchsorted(self.sorted[b], block, "right")
            n = hi - lo
            if n.any():
                left.append(np.repeat(np.arange(len(block)), n))
                right.append(self.order[b][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        if not left:
            return np.zeros(0, int), np.zeros(0, int)
        x, y = np.concatenate(left), np.concatenate(right)
        ok = np.bitwise_count(prints[x] ^ self.print[y]) <= RADIUS
        pair = np.unique(x[ok] * len(self.print) + y[ok])
        return pair // len(self.print), pair % len(self.print)

    def leaks(self, text: str) -> list[int]:
        """The items that a text gives away."""
        get = self.flag.get
        if b"1" * self.least not in b"".join([get(w, b"0") for w in _cheap(text)]):
            return []
        unknown = len(self.code)
        code = np.array([self.code.get(w, unknown) for w in words(text)], dtype=np.int64)
        found = self._short(code.tolist()) if self.short else set()
        # a stretch at a time, so that a book takes no more memory than a page does; the last words of one belong to the next too
        near = [self.near(self.prints(code[at : at + STRETCH + RUN - 1])) for at in range(0, len(code), STRETCH)]
        x = np.concatenate([np.zeros(0, int), *(a + k * STRETCH for k, (a, _) in enumerate(near))])
        y = np.concatenate([np.zeros(0, int), *(b for _, b in near)])
        for p in np.unique(self.owner[y]).tolist():
            mine = self.owner[y] == p
            if p not in found and self.holds(code, self.coded[p], x[mine], self.at[y[mine]], self.weight):
                found.add(p)
        return [i for p in sorted(found) for i in self.items[p]]

    def _short(self, code: list[int]) -> set[int]:
        """The passages found from exact windows of fewer than RUN words."""
        found: set[int] = set()
        for width, windows in self.short.items():
            for at in range(len(code) - width + 1):
                for p, of in windows.get(tuple(code[at : at + width]), ()):
                    if p not in found and _extends(code, self.coded[p].tolist(), at, of):
                        found.add(p)
        return found

    @staticmethod
    def holds(doc: np.ndarray, item: np.ndarray, at: np.ndarray, of: np.ndarray, weight: np.ndarray) -> bool:
        """Whether a part of ``doc`` around windows ``at`` aligns with enough consecutive words of ``item``."""
        # similarity of the two shingles: the weight of the words they share by place against that of the item's shingle
        a, b = doc[at[:, None] + np.arange(RUN)], item[of[:, None] + np.arange(RUN)]
        good = (weight[b] * (a == b)).sum(axis=1) >= SIMILAR * weight[b].sum(axis=1)
        # equal windows lie in every part that counts; of windows that follow each other in both texts the first serves
        good &= (a == b).all(axis=1)
        o = np.lexsort((at[good], at[good] - of[good]))
        at, of = at[good][o], of[good][o]
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(of) != 1)
        words = item.tolist()
        return any(_extends(doc, words, i, j) for i, j in zip(at[first].tolist(), of[first].tolist()))


def _width(n: int) -> int:
    """Words in a row that are left of a passage of n words with one edit in ten at most, wherever the edits are; RUN at most."""
    edits = min(n, MIN_WORDS) // EDIT_SHARE
    return min(RUN, -(-(n - edits) // (edits + 1)))


def _extends(doc: list[int] | np.ndarray, item: list[int], at: int, of: int) -> bool:
    """Whether equal words at ``at`` and ``of`` lie in a part of MIN_WORDS or more consecutive item words (or all) with one edit in ten at most."""
    need, far = min(MIN_WORDS, len(item)), len(item) + EDITS
    left = _reach(item[:of][::-1], list(doc[max(0, at - far) : at])[::-1])
    right = _reach(item[of:], list(doc[at : at + far]))
    return any(n + k >= need and (e + f) * EDIT_SHARE <= n + k for e, n in enumerate(left) for f, k in enumerate(right))


def _reach(item: list[int], doc: list[int]) -> list[int]:
    """For 0 to EDITS edits, to which item word at most the two agree from their start, by the furthest point on each diagonal."""

    def slide(i: int, d: int) -> int:
        while i < len(item) and i + d < len(doc) and item[i] == doc[i + d]:
            i += 1
        return i

    reached = {0: slide(0, 0)}
    out = [reached[0]]
    for _ in range(EDITS):
        step: dict[int, int] = {}
        for d, i in reached.items():
            for to, k in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # replaced, dropped, added
                if k <= len(item) and k + to <= len(doc):
                    step[to] = max(k, step.get(to, 0))
        reached = {d: slide(i, d) for d, i in step.items()}
        out.append(max([out[-1], *reached.values()]))
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id) of every document that gives an item away.

    ``items`` is a bounded set of queries: it is read in blocks of ITEMS_PER_PASS and each block meets every document once. Null or
    empty texts and passages without words give nothing; items with equal passages all count; extra columns are ignored.
    """
    from pyspark.sql.types import StructField, StructType

    rows = sorted({(r[0], r[1]) for r in items.select(item_id, passage).where(f"`{passage}` is not null").toLocalIterator()})
    schema = StructType([StructField(doc_id, documents.schema[doc_id].dataType), StructField(item_id, items.schema[item_id].dataType)])
    docs = documents.where(F.col(text).isNotNull()).select(doc_id, text)
    out = None
    for k in range(0, max(1, len(rows)), ITEMS_PER_PASS):
        # ITEMS_PER_PASS bounds what is broadcast: some 2 KB an item
        shared = documents.sparkSession.sparkContext.broadcast(Items(rows[k : k + ITEMS_PER_PASS]))

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                found = [(i, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in known.leaks(t)]
                if found:
                    yield pa.record_batch([pa.array([f[0] for f in found], b.schema.field(0).type), pa.array([f[1] for f in found], pa.int64())], [doc_id, item_id])

        part = docs.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, item_id, n_documents): per item how many documents give it away, 0 included."""
    n = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return items.select("suite", "item_id").distinct().join(n, "item_id", "left").select("suite", "item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))
