"""Token ids of whole texts under a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

Ordinary text of Latin script is cut into pre-tokens by a compiled pattern of the standard library and each pre-token's ids are kept in a bounded table;
any other text, and any that holds the string of an added token such as the end-of-text mark, goes to the tokenizer as a whole. Both ways give the tokenizer's own ids (tests hold them against it).
"""

from __future__ import annotations

import re
import struct

#: Characters on which the standard library's classes and the vocabulary's pattern are known to agree.
_OTHER = re.compile(r"[^\t\n\r -~¡-¬®-ɏ]")
_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = r"0-9²³¹¼-¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")
_KEEP = 400_000


class Encoder:
    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.tok = Tokenizer.from_file(path)
        names = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, names)) if names else r"(?!)")
        self.known: dict[str, bytes] = {}
        self.single = self._single(path)

    def _single(self, path: str):
        """Encodes one pre-token by the same merges with less overhead: in a byte-level vocabulary without gaps the id is the merge's rank."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        ranks = {bytes(shown[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return self.np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if not text:
            return b""
        if _OTHER.search(text) or self.added.search(text):
            return self.whole(text)
        known, parts = self.known, _PIECES.findall(text)
        new = [p for p in set(parts) if p not in known]
        if new:
            if len(known) > _KEEP:
                known.clear()
                new = list(set(parts))
            for p in new:
                ids = self.single(p)
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, parts))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
