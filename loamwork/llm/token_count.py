"""Token counts by overlap resynchronisation.

A document longer than ``chunk`` characters is encoded in overlapping chunks with offsets.  Inside each
overlap both encodings are compared, and they are spliced at a common token start that is proven stable: a
place before which no later character, and after which no earlier one, can change a token.  If an overlap has
no such place it is widened, at last to the whole of both chunks.  A shorter document is one chunk.

What is proven stable depends on the kind of vocabulary.  ``word``: white space never lies inside a token and
is dropped, so a token start after white space is stable.  ``byte``: a space between two non-spaces starts a
pre-token, so a token start at such a space is stable.

Counting under ``word`` goes the same way, by smaller chunks: a chunk's tokens are counted word by word, each worker
remembering counts of words, and of an overlap the words with their places are read from both chunks, whose cut words
differ; the chunks are spliced at the last start that both have and that is proven stable.
"""

from __future__ import annotations

import functools
import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loamwork.llm.common import documents, id_text, map_rows
from loamwork.llm.memo import Memo

#: White space on which both str.split() and the vocabulary's \s agree; a text with any other goes to the library whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_NO_SPACE = re.compile(r"\S+")
#: Characters of a chunk that is counted, and of an overlap.
CHARS, OVERLAP = 4096, 128


def stable_word(text: str, at: int) -> bool:
    return at > 0 and text[at - 1] in " \t\n\r"


def stable_byte(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


_STABLE = {"word": stable_word, "byte": stable_byte}


class Resynchroniser:
    """Encodes whole texts chunk by chunk.  encode() gives (ids, [(start, end)]) equal to the library's own."""

    def __init__(self, path: str, kind: str = "word", chunk: int = 32_768, overlap: int = 512):
        from tokenizers import Tokenizer

        if not 0 < overlap < chunk:
            raise ValueError("overlap must lie between 0 and chunk")
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._stable, self.chunk, self.overlap, self.kind = _STABLE[kind], chunk, overlap, kind
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._words = Memo(self._count_word)
        self.widened = 0
        self._ranks = self._rank_encoder(path) if kind == "word" else None

    @staticmethod
    def _rank_encoder(path: str):
        return WordRanks.of(path)

    def _chunk(self, text: str, a: int, b: int):
        got = self._tokenizer.encode(text[a:b], add_special_tokens=False)
        return got.ids, [(a + s, a + e) for s, e in got.offsets]

    def _splice(self, text: str, left, right, low: int, high: int):
        """The last stable start in [low, high) that both encodings have, as indices into both, or None."""
        starts = {s: k for k, (s, _) in reversed(list(enumerate(right[1]))) if low <= s < high}
        for k in range(len(left[1]) - 1, -1, -1):
            s = left[1][k][0]
            if s < low:
                break
            if s < high and s in starts and self._stable(text, s) and (k == 0 or left[1][k - 1][1] <= s):
                return k, starts[s]
        return None

    def encode(self, text: str):
        n = len(text)
        end = min(n, self.chunk)
        ids, spans = self._chunk(text, 0, end)
        ids, spans = list(ids), list(spans)
        settled = 0  # where the encoding in hand starts to be open to change
        while end < n:
            overlap = self.overlap
            while True:
                a, b = max(settled, end - overlap), min(n, end - overlap + self.chunk) if end - overlap > settled else n
                b = max(b, min(n, end + 1))
                right = self._chunk(text, a, b)
                cut = self._splice(text, (ids, spans), right, a + 1, end)
                if cut is not None:
                    i, j = cut
                    settled = right[1][j][0]
                    ids[i:], spans[i:] = right[0][j:], right[1][j:]
                    break
                self.widened += 1
                if a == settled:  # no stable place since the last one: encode that stretch as one
                    k = next((k for k, (s, _) in enumerate(spans) if s >= settled), len(spans))
                    ids[k:], spans[k:] = right
                    break
                overlap *= 2
            end = b
        return ids, spans

    def _count_word(self, word: str) -> int:
        if self._ranks is not None and (n := self._ranks.count(word)) is not None:
            return n
        return len(self._tokenizer.encode(word, add_special_tokens=False).ids)

    def _overlapping(self, text: str, a: int, b: int, end: int) -> list[tuple[int, int]]:
        """(start, tokens) of the words of text[a:b], cut there as the chunk is, that start before end."""
        out = []
        for m in _NO_SPACE.finditer(text, a, b):
            if m.start() >= end:
                break
            out.append((m.start(), self._words[m.group()]))
        return out

    def count(self, text: str) -> int:
        """The number of tokens of a text, by chunks of CHARS characters where white space is no part of a token."""
        if self.kind != "word" or _ODD_SPACE.search(text):
            return len(self.encode(text)[0])
        total, settled, end, n = 0, 0, min(len(text), CHARS), len(text)
        while end < n:
            overlap, after = OVERLAP, min(n, end - OVERLAP + CHARS)
            while True:
                a = max(settled, end - overlap)
                left, right = self._overlapping(text, a, end, end), dict(self._overlapping(text, a, after, end))
                # the overlap's first word may be cut on the right, its last one on the left: starts after white space agree
                cut = next((s for s, _ in reversed(left) if s > a and s in right and self._stable(text, s)), None)
                if cut is not None:
                    total += sum(map(self._words.__getitem__, text[settled:cut].split()))
                    settled = cut
                    break
                self.widened += 1
                if a == settled:  # no stable place since the last one: the stretch stays open, and grows by the next chunk
                    break
                overlap *= 2
            end = after
        return total + sum(map(self._words.__getitem__, text[settled:].split()))


class WordRanks:
    """Token counts of single words under a BPE with word ends, by a rank encoder.

    The vocabulary's merges become ranks of byte strings; the word end is one further byte that first joins
    the byte before it.  Only words of the Latin ranges whose composed and lower-case forms are certain are
    counted here; for any other count() gives None.
    """

    _PLAIN = re.compile("[!-~¡-įı-ňŊ-ž]+")
    _PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    _END = b"\xff"

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec["added_tokens"]]
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b]) + self._END] = len(ranks)
        for merge in spec["model"]["merges"]:
            joined = "".join(merge if isinstance(merge, list) else merge.split(" "))
            end = joined.endswith("</w>")
            raw = bytes(code[c] for c in (joined[:-4] if end else joined)) + self._END * end
            ranks.setdefault(raw, len(ranks))
        self._core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @classmethod
    @functools.lru_cache(maxsize=2)
    def of(cls, path: str) -> "WordRanks":
        return cls(path)

    def count(self, word: str) -> int | None:
        if not self._PLAIN.fullmatch(word) or any(c in word for c in "ª²³¹º¼½¾µ­") or "<|" in word:
            return None
        encode = self._core.encode_single_piece
        return sum(len(encode(p.encode() + self._END)) for p in self._PIECE.findall(word.lower()))


@functools.lru_cache(maxsize=2)
def _counter(path: str, kind: str, chunk: int, overlap: int) -> Resynchroniser:
    return Resynchroniser(path, kind, chunk, overlap)


def count_tokens(docs: DataFrame, path: str | None = None, kind: str = "word", limit: int = 2048, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    A null or empty text has 0 tokens; repeated rows each give a row; an empty table gives none; other columns
    are ignored.  Special strings inside texts are handled as the library does by default.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def count(ids: list[int], texts: list[str]) -> dict:
        counter = _counter(path, kind, chunk, overlap)
        tokens = [counter.count(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_rows(id_text(docs), ["doc_id", "text"], count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
