"""Exact tokenisation by public vocabulary files, with a memo of chunks that never meet across a boundary."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import re
from array import array
from functools import lru_cache

#: Chunks kept by a worker's memo; a full memo starts afresh. Longer chunks are not kept.
MEMO_CHUNKS, MEMO_CHARS = 300_000, 48

#: The split rule of a byte-level tokenizer's own pre-tokenizer, and the code points that stand for its bytes: fixed values.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(33, 126), (161, 172), (174, 255)]

#: A space before white space or the end: runs of white space cross that cut, so such texts are encoded whole.
UNSAFE = re.compile(r" (?:\s|\Z)")


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _bytes_of() -> dict[str, int]:
    shown = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def _as_ranks(path: str):
    """The same tokenizer as a table of ranks, or None where that would not give the library's ids.

    It holds for a byte-level BPE without normaliser or prefix space whose k-th merge makes the k-th token
    after the bytes, and whose added tokens hold no white space and take none from their sides.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    if model.get("type") != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t.get("normalized") and spec.get("normalizer") or re.search(r"\s", t["content"]) for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if [model["vocab"].get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    back = _bytes_of()
    ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    if len(ranks) != 256 + len(merges):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, or their number.

    Every text gets the ids that the file's own library gives without added special tokens. Where the tokenizer
    allows it, texts are cut before single spaces, where no token can cross, and each chunk is encoded once
    per worker; other texts and other tokenizers are encoded whole by the library.
    """

    def __init__(self, path: str, counts_only: bool = False):
        self.ranks = None if path.endswith(".model") else _as_ranks(path)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda text: model.encode(text, num_threads=1)
        elif self.ranks:
            self._whole = lambda text: self.ranks.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self._whole = lambda text: model.encode(text, add_special_tokens=False).ids
        whole = self._whole
        value = (lambda text: len(whole(text))) if counts_only else (lambda text: array("I", whole(text)).tobytes())

        class Memo(dict):
            def __missing__(self, chunk):
                v = value(" " + chunk)
                if len(chunk) <= MEMO_CHARS:
                    if len(self) >= MEMO_CHUNKS:
                        self.clear()
                    self[chunk] = v
                return v

        memo = Memo()
        get = memo.__getitem__
        if not self.ranks:
            self.encode = value
        elif counts_only:
            self.encode = lambda text: value(text) if UNSAFE.search(text) else value((p := text.split(" "))[0]) + sum(map(get, p[1:]))
        else:
            self.encode = lambda text: value(text) if UNSAFE.search(text) else value((p := text.split(" "))[0]) + b"".join(map(get, p[1:]))


@lru_cache(maxsize=1)
def encoder(path: str, counts_only: bool = False) -> Encoder:
    """A worker's one encoder, which its tasks share: an encoder's memo refers to itself, so those of ended tasks would stay until Python's collector finds them."""
    return Encoder(path, counts_only)
