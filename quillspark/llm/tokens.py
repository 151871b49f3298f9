"""Token counts by byte-pair merging with a heap and a linked list.

Each piece of a text starts as its bytes in a linked list; a heap holds the adjacent pairs that
merge, by rank and place. Popping the lowest pair and linking its neighbours anew goes on until
none is left, and the count is the bytes less the merges: no token identifiers are made. Pieces
recur, so a worker keeps the counts of the pieces it has met, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_KEPT = 1 << 18

#: Where the library's Unicode tables differ from those of this process. Code points
#: (hexadecimal ranges) that `regex` takes for letters or numbers and the library for neither.
NO_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Capitals whose lower case Python does not know: first, last, and the way to the small letter.
LATE_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27)]
_FIRST_LATE = "\u0558"


def _ranges(text: str) -> list[int]:
    ends = [[int(x, 16) for x in r.split("-")] for r in text.split()]
    return [c for e in ends for c in range(e[0], e[-1] + 1)]


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others for the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairCounter:
    """Counts tokens as the vocabulary file's own library does.

    The file names a normaliser (NFC and lower case), the pattern of the pieces and the merges
    with their ranks; the special strings that it adds are found in the raw text first, and each
    counts one.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not {"NFC", "Lowercase"} <= set(kinds):
            raise ValueError(f"{path} is of a kind not counted here")
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.letters = _byte_letters()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Its library matches by the Unicode White_Space property, which \s here is too.
        self.pieces, self.spans = regex.compile(split, regex.V0).findall, regex.compile(split, regex.V0).finditer
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = sorted({t[0] for t in special if t})  # what a special string begins with
        self.known: dict[str, int] = {}
        self.lower = {c: c + by for a, b, by in LATE_CAPITALS for c in range(a, b + 1)}
        self.other = dict.fromkeys(_ranges(NO_LETTERS), "\ue000")  # stands for what is neither letter nor number

    def piece(self, piece: str) -> int:
        """The tokens of one piece."""
        letters = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        n = len(letters)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, merges = self.ranks, 0
        heap = [(r, i, letters[i], letters[i + 1]) for i in range(n - 1) if (r := ranks.get((letters[i], letters[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if letters[i] == a else n
            if j >= n or letters[j] != b:
                continue  # one of the two has merged since
            letters[i], letters[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            merges += 1
            if left[i] >= 0 and (r := ranks.get((letters[left[i]], a + b))) is not None:
                heapq.heappush(heap, (r, left[i], letters[left[i]], a + b))
            if right[i] < n and (r := ranks.get((a + b, letters[right[i]]))) is not None:
                heapq.heappush(heap, (r, i, a + b, letters[right[i]]))
        return n - merges

    def _plain(self, text: str) -> int:
        # Letter by letter lower case: the capital sigma has one form wherever it stands.
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        text = text.replace("Σ", "σ").lower()
        if text.isascii() or max(text) < _FIRST_LATE:
            pieces = self.pieces(text)
        else:
            text = text.translate(self.lower)
            pieces = [text[m.start() : m.end()] for m in self.spans(text.translate(self.other))]
        known, total = self.known, 0
        for piece, times in Counter(pieces).items():
            n = known.get(piece)
            if n is None:
                n = self.piece(piece)
                if len(piece) <= 64:
                    if len(known) >= _KEPT:
                        known.clear()
                    known[piece] = n
            total += n * times
        return total

    def count(self, text: str | None) -> int:
        """The tokens of a whole text, without begin, end or added special tokens; null: 0."""
        if not text:
            return 0
        if not any(mark in text for mark in self.marks):
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


_COUNTERS: dict[str, PairCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, n_bytes long, n_tokens long, over_limit boolean) for every row of docs.

    vocabulary: the path of the vocabulary file, which every executor must see. A null text counts
    as empty: 0 bytes, 0 tokens. Null and repeated ids keep their rows. Other columns are not read.
    """

    def run(batches):
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = PairCounter(vocabulary)
        counter = _COUNTERS[vocabulary]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counter.count(t) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
