"""SentencePiece encoding with byte spans, and decoding.

Normalisation takes, at every place, the longest prefix that the model's compiled character map knows, and notes for
each normalised byte the source byte it came from. The pieces' lengths in normalised bytes then give, through that
alignment, each piece's end in the source. Piece ids are those of the sentencepiece library.

Texts repeat words, so where the model allows it a text is cut at word starts and every distinct word of a block is
encoded once. It allows it if it has no character map, keeps all blanks, and has no piece with a word start inside:
then no merge can reach over such a cut, and the ids are the same as those of the whole text (tests compare both).

Defined cases: a null text is the empty text (no pieces, decoded to the empty text); texts of any length are encoded
whole; repeated rows give equal rows; an empty table gives no rows; of two
rules of the character map the longer prefix counts, so ties cannot arise. New columns take the place of input columns of the same name.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from .common import add_columns, texts_of

SPACE = "▁"
_BLANK = SPACE.encode()
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class CharacterMap:
    """A model's compiled map: a double-array trie of source prefixes, with the offsets of their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.replacements = blob[4 + size:]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of source[at:] and what replaces it."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        node ^= self._offset(units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1]:self.replacements.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Encoder:
    """A loaded model: ids and source ends of the pieces of a text."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        # Plain flags: a part of the message would keep all of it in memory.
        self.prefix, self.escape = proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.escape_whitespaces
        self.trim = proto.normalizer_spec.remove_extra_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_piece = [p.type == p.BYTE for p in proto.pieces]
        self.unknown = [p.type == p.UNKNOWN for p in proto.pieces]
        self.size = [1 if b else len(p.piece.encode()) for p, b in zip(proto.pieces, self.byte_piece)]
        self.by_word = (not self.map.units and self.prefix and self.escape and not self.trim and not self.suffix
                        and proto.trainer_spec.byte_fallback and any(p.piece == SPACE for p in proto.pieces)
                        and not any(SPACE in p.piece.lstrip(SPACE) or " " in p.piece or p.type == p.USER_DEFINED
                                    for p in proto.pieces))
        self.sizes = np.array(self.size, np.int64)
        self.blank = self.library.piece_to_id(SPACE)

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them (and the end) the place in the source where it begins."""
        source, trim = text.encode(), self.trim
        blank = _BLANK if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def step(at: int) -> tuple[int, bytes]:
            known = self.map.longest(source, at)
            if known:
                return known
            first = source[at]
            n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            return n, source[at:at + n]

        while trim and at < len(source):
            n, new = step(at)
            if new.strip(b" "):
                break
            at += n

        def put(new: bytes, start: int) -> None:
            out.extend(new)
            align.extend([start] * len(new))

        if at < len(source) and self.prefix and not self.suffix:
            put(blank, at)
        was_blank = trim
        while at < len(source):
            n, new = step(at)
            while was_blank and new.startswith(b" "):
                new = new[1:]
            for byte in new:
                if byte == 32:
                    put(blank, at)
                else:
                    put(bytes([byte]), at)
            if new:
                was_blank = trim and new.endswith(b" ")
            at += n
        while trim and out.endswith(blank):
            del out[-len(blank):], align[-len(blank):]
        if out and self.prefix and self.suffix:
            put(blank, len(source))
        return bytes(out), [*align, len(source)]

    def encode_whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and source ends without the cut at words; right for every model."""
        ids = self.library.encode(text)
        normal, align = self.normalise(text)
        ends, at = [], 0
        for i in ids:
            if self.unknown[i]:  # an unknown stretch ends where the next known piece begins
                at = self._after_unknown(normal, at)
            else:
                at += self.size[i]
            ends.append(align[min(at, len(normal))])
        if ends:
            ends[-1] = align[-1]
        return np.array(ids, np.int32), np.array(ends, np.int32)

    def _after_unknown(self, normal: bytes, at: int) -> int:
        at += 1
        while at < len(normal) and normal[at] & 0xC0 == 0x80:
            at += 1
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of pieces of every text, and all ids and ends one after the other."""
        whole = [not self.by_word or SPACE in t for t in texts]
        counts, ids, ends = self._by_words([t for t, w in zip(texts, whole) if not w])
        if not any(whole):
            return counts, ids, ends
        cuts = np.cumsum(counts)[:-1]
        words = iter(zip(np.split(ids, cuts), np.split(ends, cuts)))
        parts = [self.encode_whole(t) if w else next(words) for t, w in zip(texts, whole)]
        return np.array([len(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (0, 1))

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known: dict[str, int] = {}
        number, codes, n_words = known.setdefault, [], []
        for text in texts:
            words = _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []
            codes += [number(w, len(known)) for w in words]
            n_words.append(len(words))
        if not codes:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        # Distinct words: their ids, and the ends of their pieces counted from the word's start in the source. The
        # library puts the first blank back, but not on an empty text. A blank is three bytes there, one in the source.
        coded = [ids or [self.blank] for ids in self.library.encode([w[1:] for w in known], num_threads=1)]
        pieces = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(pieces.sum()))
        starts = np.cumsum(pieces) - pieces
        cut = np.cumsum(self.sizes[flat])
        cut -= np.repeat(cut[starts] - self.sizes[flat[starts]], pieces)
        blanks = np.fromiter((len(w) - len(w.lstrip(SPACE)) for w in known), np.int64, len(known))
        cut -= 2 * np.minimum(np.repeat(blanks, pieces), cut // 3)
        length = cut[starts + pieces - 1]
        # Words in their order in the texts.
        codes, n_words = np.array(codes), np.array(n_words)
        n = pieces[codes]
        before = np.cumsum(length[codes]) - length[codes]
        heads = np.repeat((np.cumsum(n_words) - n_words), n_words)
        before -= before[heads] + 1  # the first blank of a text is not in the source
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[codes], n)
        of_text = np.repeat(np.arange(len(texts)), n_words)
        counts = np.bincount(of_text, n, minlength=len(texts)).astype(np.int64)
        return counts, flat[at], np.maximum(cut[at] + np.repeat(before, n), 0).astype(np.int32)

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of every run of ids."""
        flat, ends = ids.tolist(), np.cumsum(counts).tolist()
        return [self.library.decode(flat[e - n:e]) if n else "" for n, e in zip(counts.tolist(), ends)]


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all if not given) with `ids`, `ends` (source byte after each piece) and `decoded`.

    A piece covers the bytes from the end before it to its own. The model is read on the driver and broadcast
    (its size does not depend on the data).
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(block):
        encoder = _loaded(shared.value)
        counts, ids, ends = encoder.encode(texts_of(block))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(ends)),
                pa.array(encoder.decode(counts, ids), pa.string())]
    whole = ArrayType(IntegerType())
    return add_columns(docs, docs.columns if keep is None else keep,
                       [StructField("ids", whole), StructField("ends", whole), StructField("decoded", StringType())], run)
