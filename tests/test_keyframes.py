"""Keyframes of the registered query hold both parts of the offset and the rotation."""

import math

import __spark_entry__ as entry
from trackframe import dims


def plain(preset: tuple, seed: float, speed: float, gain: float) -> list[tuple]:
    """(k, dx, dy, rot) of one motion, in plain Python."""
    p = dict(zip(dims.PARAM_KEYS, preset[1:], strict=True))
    loop = 10 / speed if p["driftX"] or p["driftY"] else 8.0
    span = loop * speed
    beat = max(1, math.floor(p["frequency"] * span + 0.5)) / span
    steps = min(200, max(60, math.floor(loop * 15 + 0.5)))

    def noise(x):
        hashed = lambda n: math.sin(n) * 43758.5453 - math.floor(math.sin(n) * 43758.5453)
        c = math.floor(x)
        f = x - c
        return hashed(c) + (hashed(c + 1) - hashed(c)) * f * f * (3 - 2 * f)

    def at(t):
        d = p["damping"]
        env = 1 + d * (noise(t * (0.6 + d * 1.8) + seed * 37.7) ** (1 + d * 4) * 2.2 - 1) if d > 0.02 else 1.0
        x, y, s = seed * 40, seed * 70, t + seed
        tx = (noise(x * 0.015 + s * 1.7 + 5.2) - 0.5) * 2 + noise(x * 0.045 + y * 0.03 + s * 3.1) - 0.5
        ty = (noise(y * 0.015 + s * 1.9 + 91.7) - 0.5) * 2 + noise(x * 0.03 + y * 0.045 + s * 2.7) - 0.5
        part = math.fmod(t, 10) / 10
        out = min(part / 0.85, (1 - part) / 0.15)
        angle, turn = 2 * math.pi * beat * t, math.radians(p["direction"])
        sway = p["amplitude"] * env * 16 * math.sin(angle + p["phaseSpread"] * seed * 3)
        rough = p["turbulence"] * env * 11
        return ((sway * math.cos(turn) + rough * tx + 26 * out * p["driftX"]) * gain, (-sway * math.sin(turn) + rough * ty + 26 * out * p["driftY"]) * gain, math.degrees(0.06 * p["amplitude"] * gain * env * math.cos(angle)))

    rows = []
    for k in range(steps + 1):
        here, w = at(k / steps * span), max(0.0, (k / steps - 0.88) / 0.12)
        rows.append((k, *(a * (1 - w) + b * w for a, b in zip(here, at(k / steps * span - span), strict=True))))
    return rows


def test_keyframes_hold_both_parts_of_the_offset(spark, tmp_path):
    parts = [(key, size) for key, size in zip(range(1, 20), range(3, 50, 2), strict=False)] + [(20, None), (7, 30)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["bake_keyframes"](spark, str(tmp_path))
    assert got.columns == ["id", "k", "frac", "dx", "dy", "rot"]
    known = sorted((r.id, r.k, r.dx, r.dy, r.rot) for r in got.collect() if r.dx is not None)
    want = sorted((key, *row) for key, size in parts if size is not None for row in plain(dims.PRESETS[key % 9], size / 50, 1 + key % 3 * 0.5, 1 + key % 2 * 0.5))
    assert len(known) == len(want) and any(abs(r[3]) > 1 for r in want)
    for mine, theirs in zip(known, want, strict=True):
        assert mine[:2] == theirs[:2] and all(abs(a - b) < 2e-5 for a, b in zip(mine[2:], theirs[2:], strict=True))
