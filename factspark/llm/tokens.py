"""Exact, cached encoding with the public tokenizers.

Whole plain Latin texts of the byte-level vocabulary go to tiktoken, which gives
the library's ids faster. Other texts are cut: a space that precedes a non-space
is always a boundary between pre-tokens of both vocabularies, so each distinct
chunk between such spaces is encoded once per worker. Chunks go to the library;
plain Latin ones of the word vocabulary go to tiktoken with their bytes renamed.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import struct

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Chunks of a vocabulary that a worker remembers before it starts afresh (about 200 bytes each);
#: more where whole texts don't go to tiktoken.
CACHE = {BYTE_BPE: 100_000, WORD_BPE: 500_000}
#: Printable characters below U+0250 and line feeds.
PLAIN = re.compile("[\n -~¡-¬®-ɏ]*")
#: Lower-case chunks of ASCII and letters below U+0250, and their pre-tokens.
PLAIN_WORDS = re.compile("[!-~ß-öø-ɏ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-z0-9ß-öø-ɏ]+")
#: Lower-case texts of such chunks, spaces and line feeds.
PLAIN_TEXT = re.compile("[\n -~ß-öø-ɏ]*")
#: Bytes of lower-case letters in such texts, and the classes of all bytes there: c for comma and full stop, p for other marks.
LETTER_BYTES = bytes([*range(0x61, 0x7B), *range(0x80, 0x100)])
CLASSES = bytes(32 if b in b" \n" else 99 if b in b",." else 97 if b in LETTER_BYTES or 0x30 <= b <= 0x39 else 112 for b in range(256))
#: Longest run without a space that tiktoken gets.
LONGEST_RUN = 4096


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordMerges:
    """Merges of the word vocabulary by tiktoken.

    tiktoken merges bytes and knows no mark of a word's end, so a byte that ends a
    word is renamed to one that the words at hand don't use. Words of letters have
    bytes a-z, 80-BF and C3-C9; the other words are ASCII.
    """

    def __init__(self, name: str) -> None:
        with open(vocabulary(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet, suffix = _byte_of_char(), model["end_of_word_suffix"]
        ranks = {"".join(pair): 256 + i for i, pair in enumerate(model["merges"])}
        letters = [*range(0x61, 0x7B), *range(0x80, 0xC0)]
        self.letters = self._merges(model["vocab"], ranks, alphabet, suffix, {*letters, *range(0xC3, 0xCA)}, {b: bytes([b - 0x60 if b < 0x80 else b - 0x65]) for b in letters})
        self.ascii = self._merges(model["vocab"], ranks, alphabet, suffix, set(range(0x80)), {b: bytes([b + 0x80]) for b in range(0x80)})

    @staticmethod
    def _merges(vocab, ranks, alphabet, suffix, inner, renamed):
        import tiktoken

        merges, ids = {bytes([b]): b for b in range(256)}, [0] * (256 + len(ranks))
        for token, ident in vocab.items():
            ends = token.endswith(suffix) and token != suffix
            body = bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token))
            if not inner.issuperset(body) or (ends and body[-1] not in renamed):
                continue
            if ends:
                body = body[:-1] + renamed[body[-1]]
            if len(body) > 1:
                merges[body] = ranks[token]
            ids[merges[body]] = ident
        one = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=merges, special_tokens={})._core_bpe.encode_single_piece
        return one, [struct.pack("<I", i) for i in ids], renamed

    def word(self, data: bytes) -> bytes:
        """ids of one word of lower-case letters, in UTF-8."""
        one, ids, renamed = self.letters
        return b"".join([ids[x] for x in one(data[:-1] + renamed[data[-1]])])

    def encode(self, chunk: str) -> bytes:
        """ids of a lower-case chunk that PLAIN_WORDS matches."""
        out = []
        for word in WORD.findall(chunk):
            one, ids, renamed = self.letters if word.isalpha() else self.ascii
            data = word.encode()
            out += [ids[x] for x in one(data[:-1] + renamed[data[-1]])]
        return b"".join(out)


class WordCache(dict):
    """ids of what stands between spaces in a plain text; what is new is encoded and remembered."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.encode(word)
        return found


class Encoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.name = name
        self.library = Tokenizer.from_file(vocabulary(name))
        self.library.no_padding()
        self.library.no_truncation()
        self.specials = [(t.content, np.array([i], "<u4").tobytes()) for i, t in sorted(self.library.get_added_tokens_decoder().items())]
        self.spaced = name == BYTE_BPE  # white space belongs to tokens
        self.fast = self.words = None
        if name == WORD_BPE:
            self.words = WordMerges(name)
        if self.spaced:
            import public_tokenizers
            import tiktoken

            with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.plain_cache = WordCache(self._plain_word)

    def _plain_word(self, word: bytes) -> bytes:
        if not word.translate(None, LETTER_BYTES):
            return self.words.word(word) if len(word) < LONGEST_RUN else self._chunk(word.decode())
        return self._chunk(word.decode())

    def _plain_words(self, text: str) -> bytes | None:
        """ids of a text by whole words; None unless it has plain characters only and no comma or full stop stands by another mark.

        Words of the vocabulary never go across a change between letters, digits
        and punctuation, so spaces around commas and full stops alter nothing.
        """
        lower = text.lower()
        if not PLAIN_TEXT.fullmatch(lower):
            return None
        data = lower.encode()
        classes = data.translate(CLASSES)
        if b"cc" in classes or b"cp" in classes or b"pc" in classes:
            return None
        out = b"".join(map(self.plain_cache.__getitem__, data.replace(b",", b" , ").replace(b".", b" . ").split()))
        if len(self.plain_cache) > CACHE[self.name]:
            self.plain_cache.clear()
        return out

    def _chunk(self, chunk: str) -> bytes:
        if self.words and len(chunk) < LONGEST_RUN and PLAIN_WORDS.fullmatch(lower := chunk.lower()):
            return self.words.encode(lower)
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if self.fast and PLAIN.fullmatch(text) and max(map(len, text.split(" "))) < LONGEST_RUN:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        if self.words and (ids := self._plain_words(text)) is not None:
            return ids
        if self.spaced:
            head, *rest = text.split(" ")
            chunks = [head]
            for piece in rest:
                if piece and not piece[0].isspace():
                    chunks.append(" " + piece)
                else:
                    chunks[-1] += " " + piece
        else:
            chunks = text.replace("\n", " ").split(" ")
        cache = self.cache
        for chunk in set(chunks).difference(cache):
            cache[chunk] = self._chunk(chunk) if chunk else b""
        out = b"".join(map(cache.__getitem__, chunks))
        if len(cache) > CACHE[self.name]:
            cache.clear()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        for content, ident in self.specials:
            if content in text:
                return ident.join(map(self.encode, text.split(content)))
        return self._plain(text)


@functools.cache
def encoder(name: str) -> Encoder:
    """One per worker process."""
    return Encoder(name)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.cache
def token_bytes(name: str) -> list[bytes]:
    """What each id of a byte-level vocabulary decodes to; special tokens as their text."""
    library, alphabet = encoder(name).library, _byte_of_char()
    added = library.get_added_tokens_decoder()
    size = library.get_vocab_size(with_added_tokens=True)
    return [added[i].content.encode() if i in added else bytes(alphabet[c] for c in library.id_to_token(i)) for i in range(size)]


@functools.cache
def decimals(size: int) -> list[bytes]:
    return [b"%d" % i for i in range(size)]
