"""Ids of whole texts by files of the tokenizers library, with a memo for repeated words."""

from __future__ import annotations

import functools
import os
import re
from array import array

#: Words whose ids a worker remembers before it starts afresh, and how many of them stay for its next task.
MEMO_WORDS = 500_000
KEPT_WORDS = 100_000


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer in ``path``, as the library gives it: the name of a special token in a text is that token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the letters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, exactly as the library does.

    A text is cut at single spaces. Both pre-tokenizers in use end a token there, so the ids of a text
    are those of its chunks in order; chunks that come again are looked up. ``spaces`` says what the
    pre-tokenizer does with the space before a chunk: "join" (byte-level, it belongs to the chunk) or
    "drop" (it vanishes, and letters are made lower case). With "join" a text that has other white space
    next to a space is given to the library whole, and so is one that names a special token.
    """

    #: Letters, then marks: two tokens to either pre-tokenizer, if it leaves or lowers the letters one by one.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,./:;=?@^_|~-]*)")

    def __init__(self, path: str, spaces: str, words: int = MEMO_WORDS):
        self.words = words
        self.tokenizer, self.join = load_tokenizer(path), spaces == "join"
        self.memo: dict[str, bytes | None] = {}
        self.others: dict[str, bytes] = {}  # runs of marks, and first chunks of texts
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        self.space = self.letters[32] if self.join else ""

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)

    def _model_ids(self, spelled: str) -> bytes:
        """Ids of one pre-token, straight from the library's model."""
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _learn(self, words: set[str]) -> None:
        memo, hard = self.memo, []
        for w in words:
            if w.isascii() and w.isalpha():
                memo[w] = self._model_ids(self.space + (w if self.join else w.lower()))
            elif simple := self.SIMPLE.fullmatch(w):
                letters, marks = simple.groups()
                ids = memo.get(letters)
                if ids is None:
                    ids = memo[letters] = self._model_ids(self.space + self._spelled(letters if self.join else letters.lower()))
                if marks:
                    if marks not in self.others:
                        self.others[marks] = self._model_ids(marks)
                    memo[w] = ids + self.others[marks]
            elif self.join and (not w or w[0].isspace() or w[-1].isspace()):
                memo[w] = None
            else:
                hard.append(w)
        if hard:
            memo.update(zip(hard, self._ids([f" {w}" for w in hard] if self.join else hard), strict=True))

    def forget(self, most: int = KEPT_WORDS) -> None:
        """Start afresh if more than ``most`` words are remembered."""
        if len(self.memo) + len(self.others) > most:
            self.memo.clear(), self.others.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        self.forget(self.words)
        out = []
        for text in texts:
            if "<" in text and self.special.search(text):
                out += self._ids([text])
                continue
            words = (text if self.join else text.replace("\n", " ")).split(" ")
            head = words.pop(0) if self.join else ""
            self._learn(set(words).difference(self.memo))
            key = f" {head}"  # no run of marks looks like it
            if head and key not in self.others:
                self.others[key] = self._ids([head])[0]
            try:
                if head and head[-1].isspace():
                    raise TypeError
                out.append((self.others[key] if head else b"") + b"".join(map(self.memo.__getitem__, words)))
            except TypeError:  # a chunk beside other white space
                out += self._ids([text])
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, spaces: str, words: int = MEMO_WORDS) -> Encoder:
    """This worker's encoder for a file."""
    return Encoder(path, spaces, words)
