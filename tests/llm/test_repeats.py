"""Runs of repeated strings: the buffer's parts change no result and bound the arrays of hashes."""

from __future__ import annotations

import random

import numpy as np

from changefeed.llm import repeats


def test_runs_do_not_depend_on_parts(monkeypatch):  # noqa: ANN001
    rnd = random.Random(8)
    data = np.frombuffer(bytes(rnd.choices(b"abc ", k=6000)) + b"z" * 500, np.uint8)
    starts, ends = np.array([0, 90, 2500]), np.array([90, 2500, 6500])
    whole = repeats.runs(data, starts, ends)
    for part in (1, 64, 777):
        monkeypatch.setattr(repeats, "PART", part)
        again = repeats.runs(data, starts, ends)
        assert all((whole[k] == again[k]).all() for k in whole)
    sizes: list[int] = []
    own = repeats.Hashes.__init__
    monkeypatch.setattr(repeats.Hashes, "__init__", lambda self, d, base=repeats.BASE: (sizes.append(len(d)), own(self, d, base))[1])
    repeats.runs(data, starts, ends)
    assert max(sizes) < 777 + 3 * repeats.LENGTH
