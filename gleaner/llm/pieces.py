"""White-space pieces of a text whose byte-level tokens can be found one by one.

The byte-level pattern never joins characters across a space that stands between a
visible character and anything else, so a text may be cut there and each piece be
encoded alone.  Texts with a space between two other white-space characters are not
cut at all (``spaced_out``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from gleaner.llm.common import trim

_RUN = re.compile(r"\s \s")

# A letter word and the mark behind it are separate matches of the pattern.
_MARKED = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+[.,]")

# One match of the pattern, whatever its length.
LETTERS = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")

# A worker keeps at most this many encoded pieces; a full one keeps
# those of the batch at hand.
CACHE_PIECES = 600_000


def merge_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file whose ids rise with its merges, else None.

    Then merging the pair of lowest id is the same as merging by the list of merges, and a
    single match can be encoded without the file's own pipeline.
    """
    spec = json.loads(vocabulary)
    model, cutter = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and spec.get("normalizer") is None
    level = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    if not plain or not level or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    # The file spells bytes as letters: visible ones as they are, the others from 256 on.
    spelled = {chr(b): b for b in visible}
    spelled |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    ids = model["vocab"]
    merged = [ids.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if merged != sorted(set(merged)) or -1 in merged:
        return None
    ranks = {bytes(spelled[c] for c in token): n for token, n in ids.items() if token not in special}
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


def spaced_out(text: str) -> bool:
    """Whether a run of white space forbids cutting the text at its spaces."""
    return _RUN.search(text) is not None


def encode_texts(texts: list[str], cache: dict[str, bytes], encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_PIECES) -> list[bytes]:
    """The packed ids of each text; ``encode`` maps pieces to packed ids.

    ``cache`` maps a piece without its leading space to the ids of space and piece.
    """
    cuts = [None if spaced_out(text) else text.split(" ") for text in texts]
    met = set().union(*(parts[1:] for parts in cuts if parts is not None))
    unknown = met.difference(cache)
    trim(cache, met, len(unknown), limit)
    marked = [piece for piece in unknown if _MARKED.fullmatch(piece)]
    fresh = list((unknown.difference(marked) | {piece[:-1] for piece in marked}).difference(cache))
    cache.update(zip(fresh, encode([" " + piece for piece in fresh]), strict=True))
    marks = dict(zip(".,", encode([".", ","]), strict=True))
    cache.update((piece, cache[piece[:-1]] + marks[piece[-1]]) for piece in marked)
    heads = encode([text if parts is None else parts[0] for text, parts in zip(texts, cuts, strict=True)])
    return [
        head if parts is None else b"".join([head, *map(cache.__getitem__, parts[1:])])
        for head, parts in zip(heads, cuts, strict=True)
    ]
