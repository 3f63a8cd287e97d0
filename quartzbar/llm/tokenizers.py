"""Vocabularies of public tokenizers, read from a folder that is a parameter and never copied."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

FOLDER = "/opt/tokenizers"

# Fixed value: the pattern that splits text into words before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(2)
def merge_table(name: str, folder: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(ids of the 256 bytes, (left, right, merged) ids in order of rank) of a byte-level vocabulary."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return [vocab[c] for c in byte_symbols()], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


#: Words whose sizes are remembered; further ones are counted each time.
KNOWN_WORDS = 500_000


class _Sizes(dict):
    """Tokens of words, counted when a word is first met."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) < KNOWN_WORDS:
            self[word] = n
        return n


@lru_cache(8)
def counter(name: str, folder: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts, without special tokens; their strings are ordinary text.

    No token of these vocabularies crosses a word's border, so a text's tokens are those of its words; each word
    is counted once where that is faster.
    """
    base = os.path.join(folder, name)
    if os.path.exists(f"{base}.tiktoken"):
        import tiktoken

        with open(f"{base}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if os.path.exists(f"{base}.model"):
        return _piece_counter(f"{base}.model")
    return _word_counter(f"{base}.json")


def _piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size())):
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    # No piece goes on after a blank: a word and the blanks before it, of which the library adds one, are apart.
    sizes = _Sizes(lambda word: len(pieces.encode(word)))
    sizes[""] = 1  # a blank by itself
    blanks = re.compile(r"(?:^| ) *[^ ]+|(?:^| ) *$")

    def count(text: str) -> int:
        if not text or "▁" in text:
            return len(pieces.encode(text))
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(sizes.__getitem__, text.split(" ")))
        first, *rest = blanks.findall(text)
        return sizes[first] + sum(sizes[w[1:]] for w in rest)

    return lambda texts: [count(t) for t in texts]


def _word_counter(path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    whole = lambda text: len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
    with open(path, encoding="utf-8") as f:
        splitter = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
    if splitter["type"] != "Split" or splitter["behavior"] != "Removed" or not splitter["invert"]:
        return lambda texts: [whole(t) for t in texts]
    # White space is dropped, so what stands between it is apart; of it Python has four signs more.
    sizes, more = _Sizes(whole), re.compile("[\x1c-\x1f]")
    return lambda texts: [whole(t) if more.search(t) else sum(map(sizes.__getitem__, t.split())) for t in texts]
