"""Token ids of whole texts, with a cache of words the tokenizer has already seen.

The tokenizers split at white space before anything else, so the ids of a text are
those of its words in a row. Each distinct word goes to the library once; texts
whose white space is unusual, and tokenizers of another make, are encoded whole.
Texts in which an added token such as ``<|endoftext|>`` may be written out are encoded
whole too: the operators take it as that token, as the library's plain ``encode`` does.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from sessionloom.llm.workers import per_worker

PIECES_KEPT, WORDS_KEPT = 300_000, 600_000
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
PLAIN_BELOW = "ɐ"
#: Runs of these pass every normalizer unchanged, and no other text turns into them.
FIXED = re.compile(r"[!#-/:<=>?@\[\]^_{|}~]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Words(dict):
    """Ids of a string as bytes, worked out on first use; a bounded number are kept."""

    def __init__(self, encode, kept: int):
        super().__init__()
        self.encode, self.room = encode, kept

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if self.room > 0:
            self.room -= 1
            self[word] = ids
        return ids


class Encoder:
    """``added``: whether added tokens written out in a text are those tokens, or plain text."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        shape = json.loads(self.tokenizer.to_str())
        steps = shape["pre_tokenizer"].get("pretokenizers", [shape["pre_tokenizer"]])
        names = [(s["type"], s.get("behavior"), s.get("invert"), s.get("use_regex")) for s in steps]
        norms = [n["type"] for n in (shape["normalizer"] or {}).get("normalizers", [shape["normalizer"]]) if n]
        spaced = names == [("ByteLevel", None, None, True)] and not steps[0]["add_prefix_space"] and not norms
        dropped = names == [("Split", "Removed", True, None), ("ByteLevel", None, None, False)]
        dropped = dropped and norms == ["NFC", "Replace", "Lowercase"]
        self.encode = self._spaced if spaced else self._dropped if dropped else self._whole
        self.marks: set[str] = set()  # each added token holds one of them
        if added:
            for token in self.tokenizer.get_added_tokens_decoder().values():
                runs = FIXED.findall(token.content)
                if runs:
                    self.marks.add(max(runs, key=len))
                else:
                    self.encode = self._whole
        self.model = self.tokenizer.model
        self.lowered = dropped
        # Pieces as they stand between blanks are many; what most of them share, the
        # letters without closing punctuation, has the larger cache.
        self.pieces = _Words(self._piece if spaced else self._word, PIECES_KEPT)
        self.letter_runs = _Words(self._letters, WORDS_KEPT)
        self.others = _Words(self._whole, PIECES_KEPT)
        self.odd_spaces = re.compile("[\x1c-\x1f]")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one blank and a piece, or of a piece that begins with its own line end."""
        if piece[0] == "\n":
            return self.others["\n"] + self._word(piece[1:])
        return self._word(" " + piece)

    def _word(self, word: str) -> bytes:
        """A run of letters and a run of punctuation are each one item for the model."""
        core = word.rstrip(PUNCTUATION)
        letters = core[1:] if core[:1] == " " else core
        if not letters.isalpha() or not letters.isascii() and max(letters) >= PLAIN_BELOW:
            return self.others[word]
        if len(core) == len(word):
            return self.letter_runs[word]
        return self.letter_runs[core] + self.others[word[len(core) :]]

    def _letters(self, core: str) -> bytes:
        if self.lowered:
            core = core.lower() if core.isascii() else self.tokenizer.normalizer.normalize_str(core)
            if not core.isalpha():
                return self._whole(core)
        mapped = core.encode().decode("latin-1").translate(self.letters)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _spaced(self, text: str) -> bytes:
        if not text:
            return b""
        if " ".join(text.split()) != text.replace("\n", " "):
            return self._whole(text)
        head, *rest = text.replace("\n", " \n").split(" ")
        pieces = self.pieces
        return self._word(head) + b"".join([pieces[p] for p in rest])

    def _dropped(self, text: str) -> bytes:
        if self.odd_spaces.search(text):
            return self._whole(text)
        pieces = self.pieces
        return b"".join([pieces[w] for w in text.split()])

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Ids of the whole text (null: none), then the end id."""
        text = text or ""
        encode = self._whole if any(m in text for m in self.marks) else self.encode
        ids = np.frombuffer(encode(text), self.dtype)
        return ids if end is None else np.append(ids, self.dtype.type(end))


def encoder(path: str) -> Encoder:
    return per_worker(("encoder", path), lambda: Encoder(path, added=True))
