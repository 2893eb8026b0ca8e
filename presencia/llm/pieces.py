"""A SentencePiece vocabulary and the cuts that no piece crosses."""

from __future__ import annotations

import re
import sys

SPACE = "▁"


def wire_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message, varints as
    numbers and the rest as bytes."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            out.append((key >> 3, varint()))
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            out.append((key >> 3, data[at : at + size]))
            at += size
    return out


class Normaliser:
    """The model's normaliser as a transducer of two states: at the start it
    writes the space mark without reading, if the model asks for one; then
    every character goes over by its arc, or as it is where it has none."""

    def __init__(self, model: bytes):
        # fixed numbers of the public format: normaliser 3; its character map 2,
        # prefix 3, removal of spaces 4, space mark 5 (each but the map on unless said)
        spec = dict(wire_fields(dict(wire_fields(model)).get(3, b"")))
        if spec.get(2) or spec.get(4, 1):
            raise ValueError("models that map characters or drop spaces are not supported")
        self.first = SPACE if spec.get(3, 1) else ""
        self.arcs = {" ": SPACE} if spec.get(5, 1) else {}

    def compose(self, text: str) -> str:
        for char, out in self.arcs.items():
            text = text.replace(char, out)
        return self.first + text if text else ""


class Pieces:
    """Pieces, scores and kinds of a model file, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(model.serialized_model_proto())
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE for a, b in pairs) or any("\n" in p for p in pairs):
            raise ValueError("pieces of this model cross word starts or lines")
        letters = {a for a, b in pairs if b in ".,"}
        #: after an ASCII letter, a full stop or comma starts a new piece
        self.cuts_marks = not any(a.isascii() and a.isalpha() for a in letters)


#: A word with the spaces before it, spaces alone, or a line end.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Remembered:
    """Results by chunk, in a bounded number of bytes.

    No piece crosses from one chunk into the next, so a text's result is put
    together from its chunks'. ``one`` works out a chunk; ``both`` joins the
    results of two neighbours.
    """

    #: What an entry takes beyond its chunk and result: slots of the table.
    ENTRY_BYTES = 100

    def __init__(self, vocabulary: Pieces, one, both, most: int):
        self.vocabulary, self.one, self.both, self.most, self.held = vocabulary, one, both, most, 0
        self.known: dict = {}

    def of(self, text: str) -> list:
        chunks = CHUNK.findall(self.vocabulary.normaliser.compose(text))
        found = list(map(self.known.get, chunks))
        if None not in found:
            return found
        for i, c in enumerate(chunks):
            if found[i] is None:
                found[i] = self.known.get(c)
                if found[i] is None:
                    found[i] = self._keep(c, self._new(c))
        return found

    def _keep(self, chunk: str, result):
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        self.known[chunk] = result
        self.held += sys.getsizeof(chunk) + sys.getsizeof(result) + self.ENTRY_BYTES
        return result

    def _new(self, chunk: str):
        if len(chunk) > 1 and self.vocabulary.cuts_marks and chunk[-1] in ".," and chunk[-2].isascii() and chunk[-2].isalpha():
            parts = [self.known.get(c) for c in (chunk[:-1], chunk[-1])]
            return self.both(*[self._keep(c, self.one(c)) if r is None else r for c, r in zip((chunk[:-1], chunk[-1]), parts)])
        return self.one(chunk)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public model file, which is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
