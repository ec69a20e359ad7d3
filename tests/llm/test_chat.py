"""Snapshot collapse against brute force."""

import random

from rootstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, a string, n_turns string"


def log():
    draw = random.Random(4)
    rows, next_id = [], 0
    for _ in range(25):
        turns = [(draw.choice(["user", "assistant", "system", None]), draw.choice(["hi", "", None, "x\ny", "ü" * 50, f"t{draw.random()}"])) for _ in range(draw.randint(1, 9))]
        turns[0] = ("user", "hello")
        cuts = [len(turns), *(draw.randint(1, len(turns)) for _ in range(draw.randint(0, 4)))]
        for cut in cuts:
            base = draw.choice([0, 1, 10])
            rows += [(next_id, base + 2 * k, *t) for k, t in enumerate(turns[:cut])]
            next_id += 1
    rows += [(next_id, 0, "user", "hello"), (next_id, 0, "user", "hello"), (next_id + 1, None, "user", "n"), (next_id + 1, 1, None, None), (None, 0, "user", "lost"), (None, 1, "user", "lost")]
    rows += [(next_id + 2, k, "user", str(k)) for k in range(500)] + [(next_id + 3, k, "user", str(k)) for k in range(499)]
    return rows


def brute(rows):
    conversations = {}
    for c, turn, role, text in rows:
        conversations.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    told = {c: tuple(t[2:] for t in sorted(ts)) for c, ts in conversations.items()}
    out = {}
    for c, turns in told.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in told.values()):
            continue
        same = [o for o, ts in told.items() if ts == turns]
        if c == min(same, key=lambda x: (x is None, x or 0)):
            text = "\n".join(f"<|im_start|>{r[1] if r[0] else 'unknown'}\n{r[3]}<|im_end|>" for r in turns)
            out[c] = (len(turns), len(same), text)
    return out


def test_against_brute_force(frame):
    rows = log()
    found = chat.collapse(frame([(*r, *"abc") for r in rows], SCHEMA)).collect()
    assert {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in found} == brute(rows) and len(found) == len(brute(rows))
    assert len(found) < len({r[0] for r in rows})


def test_nothing(frame):
    assert chat.collapse(frame([], SCHEMA)).count() == 0
