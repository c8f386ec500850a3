"""Byte-level BPE ids of many texts at once, from the vocabulary file of a public tokenizer.

The ids are those of the tokenizers library without special tokens. Texts are cut at single spaces, where the tokenizer always cuts
too; each distinct piece of a step is encoded once, and arrays of ids are put together by numpy. A text in which a space meets other
white space, where that cut is not certain, is encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per step: larger steps repeat more pieces.
STEP = 6 << 20
_UNSURE = r" ([\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000} ]|$)"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {x["content"] for x in described.get("added_tokens", ()) if x.get("special")}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins (one more entry than texts); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _UNSURE)
        pieces = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values
        heads = pc.if_else(whole, texts, flat.take(pa.array(bounds[:-1])))
        coded, head_coded = flat.dictionary_encode(), heads.dictionary_encode()
        distinct = coded.dictionary
        pool = np.array(self.bpe.encode_ordinary(" " + " ".join(distinct.to_pylist())), np.uint32)
        ends = np.cumsum(self.sizes[pool])
        starts = np.searchsorted(ends, np.concatenate(([0], np.cumsum(pc.binary_length(distinct).to_numpy().astype(np.int64) + 1))), side="right")
        starts[0] = 0
        own = [self.bpe.encode_ordinary(x) for x in head_coded.dictionary.to_pylist()]
        lengths = np.concatenate((np.diff(starts), [len(x) for x in own])).astype(np.int64)
        pool = np.concatenate((pool, np.array([i for x in own for i in x], np.uint32)))
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at[bounds[:-1]] = len(distinct) + head_coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[at]
        before = np.concatenate(([0], np.cumsum(counts)))
        out = pool[np.repeat(begin[at] - before[:-1], counts) + np.arange(before[-1])]
        return out, before[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
