"""Byte-pair encoding by a dynamic program over prefixes, and decoding.

Of all tokens that end a prefix of a word exactly one is the last token of the prefix's encoding: the one that the
encoding of the shorter prefix before it can stand next to.  So one pass over a word stores that token for each prefix,
and following the back-pointers from the end gives the ids that merging in rank order would give.  An automaton over
the vocabulary with suffix links names the tokens that end at each place; two tokens can stand side by side if, replaying both by
rank, no merge ever joins the symbols that touch.  The work is linear in the word's length, however long the word.

The rules are read from a ``tokenizers`` file: its normaliser, splitting and special tokens decide the words, its merges the
ids.  Words of ordinary length are remembered by their task, up to a bound.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import blocks, pick

#: A task remembers so many words at most, none longer than this.
REMEMBERED = 1 << 18
LONGEST_REMEMBERED = 64
#: Characters of a text that are split into words at once; cut at blanks, which never lie inside a word.
SLICE = 1 << 16
#: Ids decoded at once, by array look-ups and one join.
IDS = 1 << 16

#: Pairs of tokens of which a task remembers whether they can stand side by side.
REMEMBERED_PAIRS = 1 << 18
#: Words of so many bytes keep their prefixes' tokens in a flat array.
LONG = 1 << 16

_NEVER = 1 << 60
#: A token's length lies in its lowest bits in the automaton.
_SHIFT = 10
_LENGTH = (1 << _SHIFT) - 1


class Merges:
    """A byte-level BPE vocabulary: symbols 0 to 255 are the bytes, 256 to 511 the bytes that end a word (if marked)."""

    def __init__(self, model: dict, byte_of: dict[str, int]):
        import ahocorasick

        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.marks_end = bool(suffix)
        rank: dict[str, int] = {}
        parts: dict[str, tuple[str, str]] = {}
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> (rank, id)
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = left + right
            self.joins[vocab[left], vocab[right]] = (i, vocab[whole])
            if whole in rank:
                raise ValueError(f"two merges give {whole!r}")
            rank[whole], parts[whole] = i, (left, right)
        self.left: dict[int, tuple[int, ...]] = {}  # id -> its first symbol's growth: the symbol and the tokens it became
        self.right: dict[int, tuple[int, ...]] = {}
        self.born: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

        def symbols(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            codes = [byte_of[c] for c in body]
            if ends:
                codes[-1] += 256
            return "".join(map(chr, codes))

        for token in sorted((t for t in vocab if t not in parts), key=vocab.get):
            if len(token.removesuffix(suffix) if suffix else token) == 1 and token.removesuffix(suffix) in byte_of:
                i = vocab[token]
                self.left[i] = self.right[i] = (i,)
                self.born[i] = -1
                automaton.add_word(symbols(token), i << _SHIFT | 1)
        for token in sorted(parts, key=rank.get):  # a merge's parts are older than the merge
            i, a, b = vocab[token], vocab[parts[token][0]], vocab[parts[token][1]]
            self.born[i] = rank[token]
            if max(self.born[a], self.born[b]) >= rank[token]:
                raise ValueError("merges are not in the order in which their parts arise")
            self.left[i] = self.left[a] + (i,)
            self.right[i] = self.right[b] + (i,)
            whole = symbols(token)
            if len(whole) > _LENGTH:
                raise ValueError(f"a token is longer than {_LENGTH} bytes")
            automaton.add_word(whole, i << _SHIFT | len(whole))
        automaton.make_automaton()
        self.ending = automaton.iter

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay two tokens when their symbols are merged side by side in rank order."""
        lefts, rights, born = self.right[a], self.left[b], self.born
        i = j = 0
        while True:
            next_left = born[lefts[i + 1]] if i + 1 < len(lefts) else _NEVER
            next_right = born[rights[j + 1]] if j + 1 < len(rights) else _NEVER
            join = self.joins.get((lefts[i], rights[j]))
            # of overlapping pairs of one rank the one further left merges first
            if join is not None and join[0] < next_left and join[0] <= next_right:
                return False
            if next_left <= next_right:
                if next_left == _NEVER:
                    return True
                i += 1
                if next_left == next_right:
                    j += 1
            else:
                j += 1

    def encode(self, word: bytes) -> array:
        """Ids of one word."""
        if self.marks_end:
            text = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        else:
            text = word.decode("latin-1")
        n = len(text)
        # the last token of each prefix with its length below it, as the automaton holds them; 0: none found yet
        last = [0] * (n + 1) if n < LONG else array("q", bytes(8 * (n + 1)))
        known = self.pairs
        for end, token in self.ending(text):
            stop = end + 1
            if last[stop]:
                continue
            before = stop - (token & _LENGTH)
            if before:
                left = last[before]
                if not left:
                    continue
                pair = (left >> _SHIFT << 32) | (token >> _SHIFT)
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= REMEMBERED_PAIRS:
                        known.clear()
                    fits = known[pair] = self.compatible(left >> _SHIFT, token >> _SHIFT)
                if not fits:
                    continue
            last[stop] = token
        ids = array("I")
        at = n
        while at:
            token = last[at]
            if not token:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(token >> _SHIFT)
            at -= token & _LENGTH
        ids.reverse()
        return ids


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: The splitting for which this module has a pattern of its own; any other is left to the file's own splitter.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANKS}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


class Codec:
    """Encoder and decoder of one ``tokenizers`` file, a byte-level BPE, inside a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        if spec["model"]["type"] != "BPE" or not any(s.get("type") == "ByteLevel" for s in steps):
            raise ValueError("the file is not a byte-level BPE")
        model = spec["model"]
        if model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("the file's BPE has rules that this encoder does not know")
        self.byte_of = byte_letters()
        self.merges = Merges(model, self.byte_of)
        normaliser = (spec.get("normalizer") or {}).get("normalizers", [])
        self.known = (
            [n["type"] for n in normaliser] == ["NFC", "Replace", "Lowercase"]
            and normaliser[1]["pattern"] == {"Regex": "\\s+"} and len(steps) == 2 and steps[0].get("type") == "Split"
            and steps[0]["pattern"] == {"Regex": _KNOWN_SPLIT} and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
            and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True))
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("the file's added tokens have rules that this encoder does not know")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.remembered: dict[str, bytes] = {}
        self.classes: dict[str, bool] = {}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.tokens = np.empty(size, dtype=object)
        for token, i in [*model["vocab"].items(), *self.added.items()]:
            self.tokens[i] = token

    def _same_class(self, c: str) -> bool:
        """Whether the file's splitter sees a character as this module's pattern does."""
        same = self.classes.get(c)
        if same is None:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            same = True
            for probe in ("a" + c, c + c, "!" + c):
                own = [len(w.encode()) for w in _WORDS.findall(probe)]
                same &= own == [len(piece) for piece, _ in split(probe)]
            self.classes[c] = same
        return same

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised (their bytes are encoded one by one)."""
        if not text:
            return []
        if self.known:
            if text.isascii():
                return _ASCII_WORDS.findall(text.lower())
            clean = self.tokenizer.normalizer.normalize_str(text)
            if all(map(self._same_class, set(clean))):
                return _WORDS.findall(clean)
        else:
            clean = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def _slices(self, text: str) -> Iterator[str]:
        """Pieces of a text that can be split on their own: cut before a blank, so that words and their rules stay whole."""
        start = 0
        while len(text) - start > SLICE and self.known:
            cut = start + SLICE
            while cut < len(text) and text[cut] not in " \n":
                cut += 1
            yield text[start:cut]
            start = cut
        yield text[start:]

    def _word(self, word: str) -> bytes:
        ids = self.merges.encode(word.encode("utf-8", "surrogateescape")).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        known = self.remembered
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            for piece in self._slices(part):
                out.append(b"".join([known.get(w) or self._word(w) for w in self.words(piece)]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; ids outside the vocabulary are left out."""
        numbers = np.frombuffer(ids, dtype="<u4")
        pieces: list[str] = []
        for start in range(0, len(numbers), IDS):
            part = numbers[start : start + IDS]
            found = self.tokens[part[part < len(self.tokens)]].tolist()
            pieces.append(found if self.tokenizer.decoder else " ".join(t for t in found if t is not None))
        if self.tokenizer.decoder:
            return self.tokenizer.decoder.decode([t for part in pieces for t in part if t is not None])
        return " ".join(p for p in pieces if p)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, built once per task process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens) per row: the ids of each whole text, as the ``tokenizers`` library gives them without added tokens.

    ``ids`` is binary: little-endian unsigned 32-bit integers.  A null text is an empty one and has no ids; strings of
    special tokens inside a text are their ids.  Repeated rows and ids stay rows of their own, other columns play no
    part, an empty table gives no rows.  Very long texts are split into words in slices; one very long word takes time
    and memory in proportion to its length.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for block in blocks(batches):
            ids = [own.encode(t or "") for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                names=["doc_id", "ids", "n_tokens"])

    return rows.mapInArrow(encode, f"doc_id {id_type}, ids binary, n_tokens long")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids, n_tokens) with ``decoded``: the text of the ids as the library's decode gives it.

    Without a decoder in the file that is the tokens joined by blanks.  Null ids decode to an empty text, ids outside
    the vocabulary are left out, as the library does.
    """
    rows = encoded.select("doc_id", "ids", "n_tokens")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for block in blocks(batches, "ids"):
            texts = [own.decode(i or b"") for i in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return rows.mapInArrow(decode, f"doc_id {id_type}, ids binary, n_tokens long, decoded string")
