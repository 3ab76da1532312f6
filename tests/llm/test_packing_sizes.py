"""What packing holds of waiting pieces."""

import numpy as np

from veilspark.llm.packing import Limits, Packer, Piece


def test_sizes_of_waiting_pieces_are_kept_and_not_taken_anew(monkeypatch):
    asked = []
    loss = Piece.loss
    monkeypatch.setattr(Piece, "loss", lambda self, length=None: asked.append(0) or loss(self, length))
    packer, rng, made = Packer(Limits(window=64)), np.random.default_rng(3), 0
    for number, n in enumerate(rng.integers(1, 3000, 500).tolist()):
        made += sum(len(p.ids) for s in packer.add(Piece(number, 0, np.zeros(n, np.uint32), n, n // 3)) for p in s)
        assert packer.sizes == [(len(p.ids), 1, loss(p)) for p in packer.waiting]
    made += sum(len(p.ids) for s in packer.close() for p in s)
    assert made == np.random.default_rng(3).integers(1, 3000, 500).sum()
    assert len(asked) < 20 * 500  # a call a waiting piece and sequence before
