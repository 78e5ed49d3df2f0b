"""The pieces of a SentencePiece vocabulary file and what both operators on it need."""

from __future__ import annotations

import re
from functools import lru_cache

META = "▁"
#: The file of the piece vocabulary, by its public name.
MODEL = "piece_bpe_32k.model"


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """score: piece -> score of the ordinary pieces; ids: their ids; byte_ids: ids of the 256 byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.names.append(piece)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.byte_of[i] = value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece] = sp.get_score(i)
                self.ids[piece] = i
        self.longest = max(map(len, self.score))
        inner = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        if any(pair[1] == META and pair[0] != META for pair in inner):
            raise ValueError("a piece goes on over a word's start; texts can't be cut there")
        # No piece holds a line end in the known files; where one does, lines aren't cut.
        self.cut_lines = not any("\n" in pair for pair in inner)
        self.unit = re.compile(f"{META}+[^{META}\n]*|\n|[^{META}\n]+" if self.cut_lines else f"{META}+[^{META}]*|[^{META}]+")

    def units(self, text: str) -> list[str]:
        """The text with its dummy space, cut where no piece can lie across."""
        return self.unit.findall(META + text.replace(" ", META)) if text else []


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)
