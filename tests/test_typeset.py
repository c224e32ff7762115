"""Arrays of a batch against one text at a time, token by token and size by size."""

import math
import random
import re

import numpy as np
import pytest

from folio.config import DEFAULT
from folio.operators import layout, typeset

TOKEN = re.compile("[A-Za-z0-9" + re.escape(typeset.HOLDING) + "]+|.", re.S)
PIECES = ["word", "a", " ", "  ", "，", "。", "一二", "\n", "-x", "...", "é", " \t", "·", "Wm", "　", "x\U0001f600"]


def plain_lines(text, room, size):
    """Word by word: what fits stays on the line, a blank at a break goes."""
    most, out = math.floor(room * 100 / size), []
    for part in text.split("\n"):
        line, used = "", 0
        for token in TOKEN.findall(part.strip()):
            w = sum(map(typeset.char_units, token))
            if line.strip() and used + w > most:
                out.append(line.rstrip())
                line, used = ("", 0) if not token.strip() else (token, w)
            else:
                line, used = line + token, used + w
        out.append(line.rstrip())
    for i in range(1, len(out)):
        head = len(out[i]) - len(out[i].lstrip(typeset.NO_START))
        if out[i - 1] and head:
            out[i - 1], out[i] = out[i - 1] + out[i][:head], out[i][head:]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_lines_of_a_batch(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(200)]
    room, size = np.array([rng.choice([1.0, 20.0, 55.5, 130.0]) for _ in texts]), np.array([rng.choice([4.6, 7.0, 9.25]) for _ in texts])
    which = np.array(rng.sample(range(200), 120))
    batch = typeset.Texts(texts)
    found, count = batch.lines(which, room[which], size[which]), batch.counts(which, room[which], size[which])
    for k, i in enumerate(which.tolist()):
        own = [t for o, t in zip(found.owner.tolist(), found.texts) if o == k]
        assert own == plain_lines(texts[i], room[i], size[i]) and count[k] == len(own)
    assert found.units.tolist() == [typeset.units_of(t) for t in found.texts]
    assert typeset.Texts([]).lines(np.zeros(0, int), np.zeros(0), np.zeros(0)).texts == []


def plain_fit(text, box):
    """Size by size from the top."""
    cfg = DEFAULT

    def sizes(floor):
        s = box.size
        while s > floor + 1e-9:
            yield s
            s -= 0.25
        yield min(box.size, floor)

    wide, high = box.x1 - box.x0, box.y1 - box.y0
    count = lambda s: len(plain_lines(text, wide - 2 * layout.PAD, s))
    plain = lambda s: max(1.22 * s, min(high / box.nlines if box.nlines > 1 else 1.3 * box.size, 1.45 * s))
    if box.nlines == 1 and len(text) <= cfg.one_line_chars and count(box.size) > 1:
        for s in sizes(max(4.7, 0.78 * box.size) if wide > 300 else 4.2 if wide < 60 else 4.7):
            if count(s) == 1:
                return 1, s, plain(s)
    for s in sizes(max(4.6, 0.55 * box.size)):
        n = count(s)
        if n * plain(s) <= high + (2.0 if box.nlines == n == 1 else 0.0):
            break
    h = plain(s)
    if box.nlines >= 3 and 1 < n < box.nlines:
        h = min(max(h, high / n), 2.2 * s)
    return n, s, h


@pytest.mark.parametrize("seed", range(4))
def test_sizes_by_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        text = "".join(rng.choices(PIECES, k=rng.choice([3, 15, 80])))
        box = layout.Box(10.0, 0.0, 10.0 + rng.choice([30.0, 80.0, 250.0, 400.0]), rng.choice([9.0, 30.0, 90.0, 300.0]), rng.choice([4.0, 7.5, 10.0, 14.0]), rng.randint(1, 6))
        fit = layout.fitted(text, box)
        n, size, height = plain_fit(text, box)
        assert (len(fit.lines), fit.size) == (n, pytest.approx(size)) and fit.height == pytest.approx(height)


@pytest.mark.parametrize("seed", range(3))
def test_a_batch_is_its_blocks(seed):
    """All blocks together are placed as each by itself, in every mode."""
    rng = random.Random(seed)
    boxes = []
    for _ in range(80):
        n = rng.randint(1, 5)
        have = rng.choice([0, n])
        boxes.append(layout.Box(10.0, 5.0, rng.choice([60.0, 200.0, 420.0]), 5.0 + 22.0 * n, rng.choice([7.0, 10.0, 12.5]), n, rng.choice("lcr"), tuple(5.0 + 20.0 * i for i in range(have)),
                                tuple(rng.choice([10.0, 24.0, 30.0]) for _ in range(have)), tuple(rng.choice([20.0, 45.0, 180.0]) for _ in range(rng.choice([0, have]))), tuple(11.0 for _ in range(rng.choice([0, have])))))
    texts = ["".join(rng.choices(PIECES, k=rng.choice([2, 12, 60]))) for _ in boxes]
    cols = [[getattr(b, c) for b in boxes] for c in ("x0", "y0", "x1", "y1", "size", "nlines", "align", "ys", "xs", "widths", "heights")]
    rot = np.array([rng.choice([90, 270]) for _ in boxes])
    for work, one in ((layout.upright, layout.place), (lambda b: layout.turned(b, rot), None)):
        found = work(layout.Blocks(texts, *cols))
        for i, (t, box) in enumerate(zip(texts, boxes, strict=True)):
            own = np.flatnonzero(found.block == i)
            want = one(t, box) if one else layout.place_rotated(t, box, int(rot[i]))
            assert [(found.x[k], found.y[k], found.text[k], found.size[k]) for k in own] == want
