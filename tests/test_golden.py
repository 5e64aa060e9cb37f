"""Whole scenes in both output modes, byte for byte. GOLDEN_DIR may name a further folder of *.input.txt, *.expected.unicode.txt and *.expected.entities.txt."""

import os
from pathlib import Path

import pytest

from glyphmill.plans.config import Config
from glyphmill.plans.engine import Typesetter

FOLDERS = [Path(__file__).parent / "golden", *([Path(os.environ["GOLDEN_DIR"])] if os.environ.get("GOLDEN_DIR") else [])]
SCENES = [(f, mode) for folder in FOLDERS for f in sorted(folder.glob("*.input.txt")) for mode in ("unicode", "entities")]


@pytest.mark.parametrize("scene,mode", SCENES, ids=lambda x: getattr(x, "name", x))
def test_scene(scene, mode):
    read = lambda p: p.read_bytes().decode("utf-8")
    config = Config() if mode == "unicode" else Config(html=True, entities=True)
    want = read(scene.with_name(scene.name.replace(".input.", f".expected.{mode}.")))
    assert Typesetter(config).plan().typeset(read(scene)) == want
    if mode == "unicode":
        assert Typesetter(config).plan().typeset(want) == want
