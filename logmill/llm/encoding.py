"""Token ids of whole texts, as the library gives them, with a memo of words.

The vocabulary drops white space: its pattern never joins characters across a space or a line feed, and both are
replaced by one space before.  So a text's tokens are those of its pieces between spaces and line feeds, in order,
and a piece's tokens can be kept.  Only pieces not seen before reach the library.  A mark behind a word is a token of
its own unless another mark is next to it, so in Latin-1 texts without such neighbours it is cut off before; and they are
lower-cased before, as the library does.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np

#: Letters whose lower case and composition are their own affair, and marks that the pattern splits from letters.
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Pieces, between spaces, of nothing but such letters in lower case.
LOWER = re.compile(r"(?<![^ ])[a-zß-öø-ÿ]+(?![^ ])")
LATIN_1 = re.compile(r"[\x00-\xff]*")
MARKS = ".,;:!?#$%&*()[]{}=+/-"
#: Marks that mostly stand behind a word, and those behind what is neither letter, digit nor white space, which may join.
BEHIND = ".,;:!?"
NEIGHBOURS = re.compile(r"[.,;:!?] (?<=[^\w\s][.,;:!?] |_[.,;:!?] )")
#: Bytes of pieces that one encoder keeps at most, by their estimated size.
MEMO_BYTES = 96 << 20
#: Characters that are looked up together.
TOGETHER_CHARS = 2 << 20
#: Words that the library gets at once, as one text.
TOGETHER = 500
VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """A dictionary of bounded size in two halves: when the new one is full it becomes the old one, which goes.

    What is asked for is brought to the new half, so that frequent words stay.
    """

    def __init__(self, limit: int):
        self.half, self.size = limit // 2, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0

    def missing(self, wanted: set[str]) -> set[str]:
        """What is known of ``wanted`` comes to the new half; returns the others."""
        unseen = wanted.difference(self.new)
        if self.old:
            old = self.old
            known = [word for word in unseen if word in old]
            self.put(known, [old.pop(word) for word in known])
            unseen.difference_update(known)
        return unseen

    def put(self, words: list[str], ids: list[bytes]) -> None:
        # two objects and their place in the table
        self.size += 200 * len(words) + sum(map(len, words)) + sum(map(len, ids))
        self.new.update(zip(words, ids))


class Encoder:
    """Encode texts with the tokenizer file at ``path``; ids are bytes of unsigned 16-bit numbers."""

    def __init__(self, path: str | None = None, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path())
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.ends_word = np.zeros(1 << 16, bool)
        for token, number in self.library.get_vocab().items():
            self.ends_word[number] = token.endswith(WORD_END)
        self.memo = Memo(memo_bytes)

    def _learn(self, pieces: set[str]) -> None:
        # most pieces are words already
        memo, cut, plain, odd = self.memo, {}, set(LOWER.findall(" ".join(pieces))), []
        for piece in pieces.difference(plain):
            if piece.isalpha():
                head, tail = piece, ""
            else:
                head = piece.rstrip(MARKS)
                tail = piece[len(head) :]
            if head.isalpha() and (head.isascii() or LATIN.fullmatch(head)):
                low = head.lower()
                plain.add(low)
                if tail or low != piece:
                    cut[piece] = low, tail
                    plain.add(tail)
            else:
                odd.append(piece)
        plain.discard("")
        new = list(memo.missing(plain).difference(odd))
        texts = [new[start : start + TOGETHER] for start in range(0, len(new), TOGETHER)]
        # each of these is one word for the pattern, and the last token of a word is marked as such
        for names, found in zip(texts, self.library.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)):
            numbers = np.array(found.ids, np.uint16)
            ids, ends = numbers.tobytes(), (2 * np.flatnonzero(self.ends_word[numbers]) + 2).tolist()
            if len(ends) != len(names):
                raise ValueError("a word was cut in parts")
            memo.put(names, [ids[start:end] for start, end in zip([0, *ends], ends)])
        found = self.library.encode_batch_fast(odd, add_special_tokens=False)
        memo.put(odd, [array.array("H", one.ids).tobytes() for one in found])
        known = memo.new
        memo.put(list(cut), [known[head] + known[tail] if tail else known[head] for head, tail in cut.values()])

    def pieces(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        if text.isascii() or LATIN_1.fullmatch(text):  # beyond, a letter may turn into several characters
            text = text.lower()
            if not NEIGHBOURS.search(text):
                for mark in BEHIND:
                    text = text.replace(f"{mark} ", f" {mark} ")
        return text.split(" ")

    def __call__(self, texts: list[str]):
        """Yield the ids of each text."""
        start = 0
        while start < len(texts):
            end, chars = start + 1, len(texts[start])
            while end < len(texts) and chars + len(texts[end]) <= TOGETHER_CHARS:
                chars += len(texts[end])
                end += 1
            split = [self.pieces(text) for text in texts[start:end]]
            start = end
            self.memo.turn()
            self._learn(self.memo.missing(set().union(*split)))
            lookup = self.memo.new.__getitem__
            for pieces in split:
                yield b"".join(map(lookup, pieces))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of every token, in code points, straight from the library."""
        found = self.library.encode(text, add_special_tokens=False)
        return [(start, end, token) for (start, end), token in zip(found.offsets, found.ids)]
