"""Token counts of whole texts, by a table of strings that are one token.

A tokenizer of a .json file first splits a text into pre-tokens and merges within each. Offline, once for a vocabulary,
prove() encodes each of its strings alone and keeps those that come out as one token; the text of a pre-token of that
kind counts 1 without any merging. In the tasks the pre-tokens of each text are looked up in that table, and only the
others go through the tokenizer's own merges, each distinct one once as long as the bounded cache holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import by_text

#: How byte-level vocabularies of this kind split a text (fixed value, as the vocabulary files' description has it).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which prove() holds that pattern against the tokenizer's own splitting: Latin, Greek, Cyrillic,
#: Vietnamese, punctuation, kana, Han and Hangul. A text with any other code point is split by the tokenizer itself.
CHECKED = ((0x00, 0x557), (0x1E00, 0x1EFF), (0x2000, 0x2064), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Characters of a text that are split at once, and distinct pre-tokens that a worker remembers besides the table.
AT_ONCE, REMEMBERED = 200_000, 200_000


@dataclass(frozen=True)
class Proof:
    """What holds for a vocabulary: whole, the pre-tokens that are one token; by_pattern, whether they are written as in
    the text and BYTE_LEVEL finds them there (else as the tokenizer's splitting writes them)."""

    path: str
    whole: tuple[str, ...]
    by_pattern: bool


def _load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _split(tokenizer, text: str) -> list[str]:
    """The pre-tokens of a text, as the tokenizer writes them for its merges."""
    if tokenizer.normalizer is not None:
        text = tokenizer.normalizer.normalize_str(text)
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def prove(path: str) -> Proof:
    """Encodes the vocabulary's strings one by one (its size bounds the work) and checks BYTE_LEVEL on all of CHECKED."""
    import json

    import regex

    tokenizer, with_added = _load(path), {a.content for a in _load(path).get_added_tokens_decoder().values()}
    described = json.loads(tokenizer.to_str())
    suffix = described["model"].get("end_of_word_suffix") or ""
    words = sorted({w.removesuffix(suffix) for w in tokenizer.get_vocab(with_added_tokens=False)} - with_added - {""})
    splitting = described.get("pre_tokenizer") or {}
    by_pattern = tokenizer.normalizer is None and splitting.get("type") == "ByteLevel" and splitting["use_regex"] and not splitting["add_prefix_space"]
    if by_pattern:
        pattern = regex.compile(BYTE_LEVEL)
        for low, high in CHECKED:
            marks = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}'s{chr(c)}\n" for c in range(low, high + 1))
            by_pattern &= pattern.findall(marks) == [marks[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(marks)]
    if not by_pattern:
        return Proof(path, tuple(w for w in words if len(tokenizer.model.tokenize(w)) == 1), False)
    texts = [t for t in (tokenizer.decoder.decode([w]) for w in words) if "�" not in t]  # others are parts of characters
    alone = tokenizer.encode_batch(texts, add_special_tokens=False)
    return Proof(path, tuple(t for t, e in zip(texts, alone, strict=True) if len(e.ids) == 1 and pattern.fullmatch(t) and pattern.findall(t) == [t]), True)


class _Sizes(dict):
    """Tokens of a pre-token: 1 for the proven ones, and what merging gives for others, of which it remembers some."""

    def __init__(self, proof: Proof, merge: Callable[[str], int]):
        super().__init__(dict.fromkeys(proof.whole, 1))
        self.proven, self.merge, self.merged = len(self), merge, 0

    def __missing__(self, piece: str) -> int:
        self.merged += 1
        n = self.merge(piece)
        if len(self) >= self.proven + REMEMBERED:
            for other in [p for p, _ in zip(reversed(self), range(REMEMBERED), strict=False)]:
                del self[other]
        self[piece] = n
        return n


class TextCounter:
    """Counts the tokens of texts as the tokenizer does by default, without tokens that it would add around them."""

    def __init__(self, proof: Proof):
        import regex

        self.tokenizer = tokenizer = _load(proof.path)
        added = list(tokenizer.get_added_tokens_decoder().values())
        plain = not any(a.single_word or a.lstrip or a.rstrip or a.normalized for a in added)
        named = "|".join(regex.escape(a.content) for a in sorted(added, key=lambda a: -len(a.content)))
        self.special = regex.compile(named) if named and plain else None
        self.unsplit = None if plain else regex.compile(named)
        self.pattern = regex.compile(BYTE_LEVEL) if proof.by_pattern else None
        checked = "".join(f"{chr(a)}-{chr(b)}" for a, b in CHECKED)
        self.unchecked = regex.compile(f"[^{checked}]".replace("\x00", r"\x00")) if proof.by_pattern else None
        # Between two visible ASCII characters a space begins a new pre-token, whatever stands further on.
        self.seam = regex.compile(r"(?<=[!-~]) (?=[!-~])")
        self.sizes = _Sizes(proof, self._merge_raw if proof.by_pattern else self._merge)

    def _merge(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize(piece))

    def _merge_raw(self, piece: str) -> int:
        return sum(map(self._merge, _split(self.tokenizer, piece)))

    def _parts(self, text: str) -> Iterator[str]:
        """text in parts of about AT_ONCE characters, cut where no pre-token can cross."""
        at = 0
        while len(text) - at > AT_ONCE:
            cut = self.seam.search(text, at + AT_ONCE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if self.pattern is None:
            if self.tokenizer.normalizer is None:
                yield from (_split(self.tokenizer, part) for part in self._parts(text))
            else:
                yield _split(self.tokenizer, text)
            return
        own = self.unchecked.search(text) is not None
        for part in self._parts(text):
            yield [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)] if own else self.pattern.findall(part)

    def count(self, text: str) -> int:
        if self.unsplit is not None and self.unsplit.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        between, n = [text], 0
        if self.special is not None and self.special.search(text):
            between = self.special.split(text)
            n = len(between) - 1
        get = self.sizes.__getitem__
        return n + sum(sum(map(get, pieces)) for part in between if part for pieces in self._pieces(part))


_counters: dict[str, TextCounter] = {}


def counter(proof: Proof) -> TextCounter:
    """This process's counter for a vocabulary, made once."""
    if proof.path not in _counters:
        _counters.clear()
        _counters[proof.path] = TextCounter(proof)
    return _counters[proof.path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, column: str = "text", names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """docs with the bytes (UTF-8) and tokens of each text and whether it has more than limit tokens.

    path: a .json file of the tokenizers library. Null and empty texts have no bytes and no tokens. Strings of special
    tokens inside a text count as the library takes them by default. Whole texts are counted, long ones in parts; equal
    rows get equal counts; columns of docs that share a name with an added one are replaced, all others stay; an empty
    table stays empty. The table of whole tokens is as large as the vocabulary and goes to the tasks by broadcast.
    """
    proof = docs.sparkSession.sparkContext.broadcast(prove(path))

    def counts(texts: list) -> dict[str, list]:
        count = counter(proof.value).count
        return {names[1]: [count(t) if t else 0 for t in texts]}

    counted = by_text(docs, counts, f"`{names[1]}` long", column=column)
    return counted.withColumns({names[0]: F.coalesce(F.octet_length(column), F.lit(0)).cast("long"), names[2]: F.col(names[1]) > limit})
