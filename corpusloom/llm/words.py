"""Token ids of whole texts with a public word BPE tokenizer.

White space always ends a word for this tokenizer, so the ids of a text are those of its white-space separated words
one after the other.  Words repeat: the ids of each are asked from the tokenizer once and remembered, and a batch of
texts becomes one gather over the ids of its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
# Words of these characters only: the normaliser lowers each letter, and a word splits into letter runs and other runs.
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:;=>?@\[-`{-~]+$"
_RUN = r"([a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+)"
_CUT = "\x1f"
_CHUNK_BYTES = 4_000_000


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(kept))
    return [table[b] for b in range(256)]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive ranges, each given by its start and length."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Encodes batches of texts; ``memory`` bounds the number of remembered runs of letters or signs."""

    def __init__(self, path: str, memory: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        if any(not t.content.startswith("<") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("plain words must not contain an added token")
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        self.memory = memory
        self.runs: dict[str, bytes] = {"": b""}

    def _run(self, run: str) -> bytes:
        """A lower-case run of letters or of signs: the model's merges alone."""
        ids = [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and the number of ids of each."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(plain))), _RUN, "\\1" + _CUT), _CUT)
        runs = pc.dictionary_encode(cut.flatten())
        names = runs.dictionary.to_pylist()
        parts = list(map(self.runs.get, names))
        for i, ids in enumerate(parts):
            if ids is None:
                parts[i] = ids = self._run(names[i])
                if len(self.runs) < self.memory and len(names[i]) < 64:
                    self.runs[names[i]] = ids
        others = words.filter(pa.array(~plain)).to_pylist()
        codes = np.concatenate([runs.indices.to_numpy(zero_copy_only=False), np.arange(len(parts), len(parts) + len(others))])
        parts += [self._word(word) for word in others]
        count = np.ones(len(words), np.int64)
        count[plain] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        start = np.empty(len(words), np.int64)
        start[plain] = np.cumsum(count[plain]) - count[plain]
        start[~plain] = len(codes) - len(others) + np.arange(len(others))
        lengths = np.array([len(p) for p in parts], np.int64) // self.dtype.itemsize
        offsets = np.cumsum(lengths) - lengths
        codes = codes[_spread(start, count)]
        ids = np.frombuffer(b"".join(parts), self.dtype)[_spread(offsets[codes], lengths[codes])]
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        last = np.cumsum(count)
        return ids, ends[last] - ends[last - count]

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per chunk of consecutive texts: all ids, and the end of each text in them.  Null texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + _CHUNK_BYTES, side="right")))
            yield self._chunk(texts.slice(at, to - at), end)
            at = to

    def _chunk(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        ids, lengths = self._distinct(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        word_ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        if end is not None:
            ids, lengths = np.append(ids, np.array([end], self.dtype)), np.append(lengths, 1)
            codes = np.insert(codes, word_ends, len(lengths) - 1)
            word_ends = word_ends + np.arange(1, len(word_ends) + 1)
        offsets = np.cumsum(lengths) - lengths
        run = lengths[codes]
        token_ends = np.concatenate([[0], np.cumsum(run)])
        return ids[_spread(offsets[codes], run)], token_ends[word_ends]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that remembered words serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded_batches(batches: Iterable[pa.RecordBatch], path: str, text: str = "text", end: int | None = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their ids, ends of the rows' ids) for consecutive pieces of the batches."""
    for batch in batches:
        column, at = batch.column(batch.schema.get_field_index(text)), 0
        for ids, ends in encoder(path).encode(column, end):
            yield batch.slice(at, len(ends)), ids, ends
            at += len(ends)
