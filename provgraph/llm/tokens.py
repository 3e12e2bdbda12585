"""Byte-pair tokens from a public vocabulary file of ranks (base64 token, rank per line)."""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property

from pyspark.sql import SparkSession

from .files import open_at

#: The vocabulary; a parameter wherever it is used.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
#: The splitting pattern that this family of vocabularies was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = 1 << 16
#: Places where the pattern always splits, by whatever Unicode tables: before ASCII white space that follows a word
#: or a printable ASCII character, and between CJK letters and a full stop or comma.
_SEAM = re.compile("(?<=[\\w!-~])(?=[ \t\n\r])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[\u3001\u3002])")
#: What the pattern finds one after the other; the same for ASCII whatever the tables.
_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


class Tokenizer:
    """Encodes and decodes; ids from ``n`` on are free for control tokens. Pickles as its file."""

    def __init__(self, ranks: bytes):
        self.ranks = ranks

    def __reduce__(self):
        return Tokenizer, (self.ranks,)

    @cached_property
    def encoding(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.ranks.splitlines() if x)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def n(self) -> int:
        return self.encoding.n_vocab

    def encode(self, text: str) -> list[int]:
        """Tokens of a text; control strings in it are plain text.

        Long texts are encoded in parts that meet where the pattern always splits, so the tokens
        are those of the whole text. Where there is no such place for 128 Ki characters, a run of
        ASCII is encoded by the pattern's own matches, and any other run up to its next such place.
        """
        if len(text) <= 2 * _CHUNK:
            return self.encoding.encode_ordinary(text)
        out, at = array("l"), 0
        while at < len(text):
            if at + 2 * _CHUNK >= len(text):
                out.extend(self.encoding.encode_ordinary(text[at:]))
                break
            if seam := _SEAM.search(text, at + _CHUNK, at + 2 * _CHUNK):
                out.extend(self.encoding.encode_ordinary(text[at : seam.start()]))
                at = seam.start()
                continue
            until = at + 2 * _CHUNK
            if text[at : until + 1].isascii():
                for piece in _PIECES.finditer(text, at, until):
                    if piece.end() == until:  # may go on beyond
                        break
                    out.extend(self.encoding._encode_single_piece(piece[0]))
                    at = piece.end()
                if at >= until - _CHUNK:
                    continue
            seam = _SEAM.search(text, until)
            end = seam.start() if seam else len(text)
            out.extend(self.encoding.encode_ordinary(text[at:end]))
            at = end
        return out.tolist()

    def decode(self, tokens: list[int]) -> bytes:
        return self.encoding.decode_bytes(tokens)


def load(spark: SparkSession, path: str = VOCABULARY):
    """A broadcast Tokenizer from a vocabulary file that the driver can open; its size is checked."""
    with open_at(path) as source:
        if source.size() > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is too large to broadcast as a vocabulary")
        ranks = source.read()
    return spark.sparkContext.broadcast(Tokenizer(ranks))
