"""Token ids of whole texts, with the pieces between blanks memoised.

Byte-level pre-tokenisation never joins a character that is not white space with white
space after it, so a text may be cut there and the ids of the pieces joined. Each task's
worker keeps the ids of what it has met (a bounded number), and texts are cut and joined as
Arrow columns, so Python meets each distinct piece of a chunk once. A piece that is one word
with punctuation after it is two pre-tokens by the same rules: the word is kept alone, and a new
one goes to the tokenizer's model directly. Other new pieces take the tokenizer's whole path, and
texts with longer white space than single blanks and line feeds are cut by a stricter pattern.

The operators leave the library's default on: a special token of the file (``<|endoftext|>``)
is its own id wherever a text holds its string. Such a token has no white space, takes none
from its sides and does not fit a word with punctuation, so texts may still be cut; the texts
of a file with other added tokens are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode white space, as the pre-tokeniser's \s has it.
_WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall
# One word of Latin letters with ASCII punctuation (no apostrophe) after it.
_LETTERS, _MARKS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"
_WORD = re.compile(f"{_LETTERS}{_MARKS}").fullmatch
_WORD_MARKS = rf"\A(?P<word>{_LETTERS})(?P<marks>{_MARKS})\z"   # the same for Arrow

_TOKEN_ID = attrgetter("id")
CACHE_PIECES = 450_000
TOGETHER = 512


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(spare)}


def _cuts_badly(piece: str) -> bool:
    """Whether the cut before a piece falls inside a run of white space."""
    if piece[:1] == "\n":
        piece = piece[1:]
    return not piece or piece[0].isspace()


def _stays_whole(added) -> bool:
    """Whether cuts at white space and after a word leave an added token and what is beside it as they are."""
    return not (added.lstrip or added.rstrip or added.single_word or re.search(f"[{_WHITE}]", added.content)
                or _WORD("a" + added.content))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long


class PieceEncoder:
    """Encodes texts with one tokenizer file; ids are little-endian ``dtype`` bytes.

    With ``special_as_text`` the strings of special tokens are encoded like other text; ``encoder`` has it off.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        # the same file with added tokens' strings as text: quicker, and the same for texts without any of them
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] * (not special_as_text)
        self.model = self.plain.model
        pre = self.tok.pre_tokenizer
        self.splits = (self.tok.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space
                       and pre.use_regex and type(self.model).__name__ == "BPE" and not self.model.dropout
                       and all(map(_stays_whole, self.tok.get_added_tokens_decoder().values())))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit, self.cache = cache_pieces, {}
        self.letters, self.kind = _byte_letters(), "H" if self.dtype.itemsize == 2 else "I"

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), TOGETHER):
            some = texts[i:i + TOGETHER]
            tok = self.plain
            if self.added:
                joined = "\n".join(some)
                if any(a in joined for a in self.added):
                    tok = self.tok
            out += [array(self.kind, e.ids).tobytes() for e in tok.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _pre_tokens(self, before: str, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens: each word (without line feeds) with ``before`` in front; kept if there is one."""
        known = self.cache if before else {}
        out = list(map(known.get, words))
        new = [w for w, ids in zip(words, out) if ids is None]
        if not new:
            return out
        joined = before + f"\n{before}".join(new)
        letters = joined.encode("utf-8").decode("latin-1").translate(self.letters).split(self.letters[10])
        tokenize, kind = self.model.tokenize, self.kind
        fresh = [array(kind, map(_TOKEN_ID, tokenize(w))).tobytes() for w in letters]
        if before:
            self._keep(zip(new, fresh))
        rest = iter(fresh)
        return [next(rest) if ids is None else ids for ids in out]

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces: of a blank and the piece, or of the piece itself if it starts with a line feed.

        Null if the cut before the piece falls inside a run of white space. Words are kept without the
        punctuation after them, so that the bounded memory holds each word once.
        """
        split = pc.extract_regex(pieces, _WORD_MARKS)
        simple = split.is_valid().to_numpy(zero_copy_only=False)
        words, marks = (split.drop_null().field(k).dictionary_encode() for k in ("word", "marks"))
        word_ids = pa.array(self._pre_tokens(" ", _strings(words.dictionary)), pa.large_binary())
        some_marks = _strings(marks.dictionary)
        known = dict(zip(real := [m for m in some_marks if m], self._pre_tokens("", real)))
        mark_ids = pa.array([known.get(m, b"") for m in some_marks], pa.large_binary())
        joined = pc.binary_join_element_wise(word_ids.take(words.indices), mark_ids.take(marks.indices),
                                             pa.scalar(b"", pa.large_binary()))
        rest = _strings(pieces.filter(pa.array(~simple)))
        ids = list(map(self.cache.get, rest))
        missed = [i for i, raw in enumerate(ids) if raw is None and not _cuts_badly(rest[i])]
        for i, raw in zip(missed, self._whole([p if p[0] == "\n" else " " + p for p in map(rest.__getitem__, missed)])):
            ids[i] = raw
        self._keep((rest[i], ids[i]) for i in missed)
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])] = np.arange(len(pieces))
        return pa.concat_arrays([joined, pa.array(ids, pa.large_binary())]).take(pa.array(order))

    def _keep(self, found) -> None:
        for piece, ids in found:
            if len(self.cache) >= self.limit:
                break
            self.cache[piece] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Call with bounded amounts of text (``common.column_chunks``).

        Larger amounts repeat more of their pieces, each of which is looked up once.
        """
        if not self.splits:
            return self._whole(texts)
        if not texts:
            return []
        lines = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        bounds = lines.offsets.to_numpy()
        pieces = lines.flatten().dictionary_encode()
        codes, heads, distinct = pieces.indices.to_numpy(), bounds[:-1], pieces.dictionary
        head_texts = _strings(distinct.take(pa.array(codes[heads])))
        inner = np.ones(len(codes), bool)
        inner[heads] = False  # the first piece has no white space before it
        meant = np.zeros(len(distinct), bool)
        meant[codes[inner]] = True
        rows = (np.cumsum(meant) - 1)[codes]
        rows[heads] = np.arange(len(heads)) + int(meant.sum())
        table = pa.concat_arrays([self._pieces(distinct.filter(pa.array(meant))),
                                  pa.array(self._whole(head_texts), pa.large_binary())])
        joined = table.take(pa.array(rows))
        _, ends, data = joined.buffers()
        ends = np.frombuffer(ends, np.int64)[joined.offset:][bounds].tolist()
        data = memoryview(data or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        bad = table.is_null().to_numpy(zero_copy_only=False)
        for t in np.unique(np.searchsorted(bounds, np.flatnonzero(bad[rows]), "right") - 1).tolist():
            out[t] = self._strict(texts[t])
        return out

    def _strict(self, text: str) -> bytes:
        """By pieces that start with all the white space before them."""
        pieces = _PIECES(text)
        known = dict(zip(several := list(dict.fromkeys(pieces)), self._whole(several)))
        return b"".join([known[p] for p in pieces])

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.dtype).astype("<u4")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, special_as_text=False)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
