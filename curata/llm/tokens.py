"""Token ids of whole texts, encoding each distinct word once.

The public tokenizers spend most of their time on words that come again and again. Both families split a text before
they merge, and no piece crosses the boundary between a word and white space or between a letter and a full stop or
comma (in byte-level families, any ASCII sign), so the ids of a text are those of such parts in a row. Numpy or Arrow
splits a block of texts, Arrow finds its distinct parts, the tokenizer encodes those, and numpy puts the ids back in the
order of the texts. Texts whose white space a tokenizer may group otherwise take the tokenizer's plain path.
"""

from __future__ import annotations

import codecs
import os
from array import array
from collections.abc import Iterable

import numpy as np

#: White space other than the six ASCII characters, and other marks between words.
UNUSUAL = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: For byte-level families: runs of white space that a split at single spaces and line ends would tear.
RUNS = r"[ \t\n\r\x0b\x0c]{3}|[ \t\n\r\x0b\x0c]{2}$|[\t\n\r\x0b\x0c] |[ \t\r\x0b\x0c][\t\n\r\x0b\x0c]|\n[\t\n\r\x0b\x0c]|[\t\r\x0b\x0c]"
STOP = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,])"
#: For byte-level families: words of letters, and which bytes are ASCII letters or digits, and ASCII signs.
LETTERS = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
SIGN = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])


def _byte_characters() -> str:
    """The character that byte-level vocabularies write for each byte: its own if that shows, else the next one from 256 on."""
    shown, more = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}, iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(more)) for b in range(256))


class WordEncoder:
    """Encodes texts to little-endian ids. keeps_space: white space yields tokens of its own (byte-level families).

    Strings of special tokens in a text are ordinary text, as the vocabulary files' own description has it. The ids of
    words that came before are kept, in cache_bytes at most; further words are encoded anew in each block.
    """

    def __init__(self, path: str, keeps_space: bool, cache_bytes: int = 12 << 20):
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 0x10000 else np.dtype("<u4")
        self.keeps_space, self.limit = keeps_space, cache_bytes
        self.known, self.flat = pa.array([], pa.large_string()), np.zeros(0, self.dtype)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        # A mark between words that is a token by itself, wherever it stands, and never part of another one.
        self.mark = "\n" if keeps_space else " \x00 "
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        # A word of letters is one piece to a byte-level family: the same model without the steps ahead of it serves for those.
        self.letters, ahead, self.characters = None, self.tokenizer.pre_tokenizer, _byte_characters()
        if keeps_space and self.mark_id is not None and self.tokenizer.normalizer is None and isinstance(ahead, pre_tokenizers.ByteLevel) and ahead.use_regex and not ahead.add_prefix_space:
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Split(self.characters[ord(self.mark)], "isolated")

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words (an Arrow array) without white space inside, in any order, and where those of each word begin and
        how many they are. Many words are encoded as one text with marks between, which takes a fraction of the time."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring(words, self.mark.strip(" ")).to_numpy(zero_copy_only=False) if self.mark_id is not None else np.ones(len(words), bool)
        plain, alone = np.flatnonzero(~odd), np.flatnonzero(odd)
        starts, sizes, flat = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), np.zeros(0, self.dtype)
        if len(plain):
            light = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)[plain] if self.letters else np.zeros(len(plain), bool)
            plain, n = np.concatenate([plain[light], plain[~light]]), int(light.sum())
            heads = np.concatenate([np.arange(0, n, 40), np.arange(n, len(plain), 40), [len(plain)]])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(heads, pa.int32()), words.take(pa.array(plain))), pa.scalar(self.mark, pa.large_string()))
            runs, n = joined.cast(pa.large_binary()).to_pylist(), -(-n // 40)
            found = self.letters.encode_batch_fast([codecs.charmap_decode(x, "strict", self.characters)[0] for x in runs[:n]], add_special_tokens=False) if n else []
            found += self.tokenizer.encode_batch_fast([x.decode() for x in runs[n:]], add_special_tokens=False)
            # Each run ends with a mark too, so that one lies behind every word.
            found = [np.array([*e.ids, self.mark_id], self.dtype) for e in found]
            flat = np.concatenate(found)
            ends, lengths = np.flatnonzero(flat == self.mark_id), np.fromiter(map(len, found), np.int64, len(found))
            counted = np.bincount(np.repeat(np.arange(len(found)), lengths)[ends], minlength=len(found))
            whole = counted == np.diff(heads)
            if not whole.all():  # some word took a mark for its own; they go one by one
                ends, good = ends[np.repeat(whole, counted)], np.repeat(whole, np.diff(heads))
                plain, alone = plain[good], np.sort(np.concatenate([alone, plain[~good]]))
                begins = np.repeat((np.cumsum(lengths) - lengths)[whole], np.diff(heads)[whole])
            else:
                begins = np.repeat(np.cumsum(lengths) - lengths, counted)
            begins = np.maximum(begins, np.concatenate([[0], ends[:-1] + 1])[: len(ends)])
            starts[plain], sizes[plain] = begins, ends - begins
        rest = self._ids(words.take(pa.array(alone)).to_pylist())
        own = np.fromiter((len(x) // self.dtype.itemsize for x in rest), np.int64, len(rest))
        starts[alone], sizes[alone] = len(flat) + np.cumsum(own) - own, own
        return np.concatenate([flat, np.frombuffer(b"".join(rest), self.dtype)]), starts, sizes

    def encode(self, texts: Iterable[str | None], tail: int, at_once: int = 2_000_000) -> Iterable[bytes]:
        """The ids of each text (null: none) and the id tail, as bytes, in order; works on about at_once characters at a time."""
        end, block, held = int(tail).to_bytes(self.dtype.itemsize, "little"), [], 0
        for text in texts:
            text = text if isinstance(text, str) else ""
            block.append(text)
            held += len(text)
            if held >= at_once:
                yield from (x + end for x in self._block(block))
                block, held = [], 0
        yield from (x + end for x in self._block(block))

    def _block(self, texts: list[str]) -> Iterable[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, f"{UNUSUAL}|{RUNS}" if self.keeps_space else UNUSUAL).to_numpy(zero_copy_only=False)
        usual = whole.filter(pa.array(~odd))
        if self.keeps_space:
            parts, bounds = self._spaced(usual)
        else:
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(usual), STOP, r"\1 \2"))
            parts, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
        encoded = parts.dictionary_encode()
        words, at = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, ends = self._gather(at, words)
        size = self.dtype.itemsize
        cuts, rest = iter(zip(ends[bounds[:-1]] * size, ends[bounds[1:]] * size, strict=True)), iter(self._ids([x for x, o in zip(texts, odd, strict=True) if o]))
        raw = memoryview(ids).cast("B")
        for o in odd:
            if o:
                yield next(rest)
            else:
                a, b = next(cuts)
                yield bytes(raw[a:b])

    @staticmethod
    def _spaced(texts) -> tuple:
        """The parts of texts (an Arrow array without nulls) with the space ahead of each, and where those of each text begin
        and end. A part begins at a space, at a line end and behind it, at a sign behind a letter or digit, and with a text."""
        import pyarrow as pa

        _, heads, raw = texts.buffers()
        bounds = np.frombuffer(heads, np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
        line = data == ord("\n")
        cut = line | (data == ord(" "))
        cut[1:] |= line[:-1]
        signs = np.flatnonzero(SIGN[data])
        one, two = data[np.maximum(signs - 1, 0)], data[np.maximum(signs - 2, 0)]  # at a text's head they are another's; a part begins there anyway
        cut[signs] |= ALNUM[one] | ((two == 0xC3) & (one != 0x97) & (one != 0xB7))
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        cut[: bounds[0]] = False
        begins = np.flatnonzero(cut)
        parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), raw if len(data) else pa.py_buffer(b""))
        return parts, np.searchsorted(begins, bounds)

    def _gather(self, at: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at, and where those of each part end (with a leading 0)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(words, value_set=self.known)
        missing = pc.is_null(found)
        new = words.filter(missing)
        ids, begins, sizes = self._ids_of_words(new)
        flat, starts, lengths = np.concatenate([self.flat, ids]), np.concatenate([self.starts, begins + np.int32(len(self.flat))]), np.concatenate([self.sizes, sizes])
        missing, index = missing.to_numpy(zero_copy_only=False), pc.fill_null(found, 0).to_numpy().copy()
        index[missing] = np.arange(len(self.sizes), len(lengths), dtype=np.int32)
        if self.known.nbytes + self.flat.nbytes + self.starts.nbytes + self.sizes.nbytes < self.limit:
            self.known, self.flat, self.starts, self.sizes = pa.concat_arrays([self.known, new]), flat, starts, lengths
        starts, own = starts[index], lengths[index][at]
        ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        # Each id's place in flat: its place in the output, moved by as much as its part is.
        width = np.int32 if len(flat) + ends[-1] < 1 << 31 else np.int64
        place = np.repeat((starts[at] - ends[:-1]).astype(width), own)
        place += np.arange(ends[-1], dtype=width)
        return flat[place], ends


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """This process's encoder for the vocabulary at path, made once."""
    # Spark's tasks are the parallel work; threads below them would only contend.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, keeps_space)
    return _encoders[key]
