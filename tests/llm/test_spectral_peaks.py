import cmath
import math
import random

from scarpline.llm import media


def plain(samples):
    """Peak pairs by a discrete Fourier transform written out, frame by frame."""
    x = list(samples) + [128] * (media.FRAME - len(samples))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    best = []
    for at in range(0, len(x) - media.FRAME + 1, media.HOP):
        frame = [(x[at + i] - 128) * window[i] for i in range(media.FRAME)]
        size = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / media.FRAME) for i, v in enumerate(frame))) for k in range(1, media.FRAME // 2 + 1)]
        best.append((max(size), size.index(max(size))))
    power = [-1, *[p for p, _ in best], -1]
    peaks = [i for i in range(len(best)) if power[i] < power[i + 1] >= power[i + 2]]
    return sorted((a, best[a][1] << 16 | best[b][1] << 8 | (b - a)) for n, a in enumerate(peaks) for b in peaks[n + 1 : n + 1 + media.FAN] if b - a <= media.REACH)


def test_peak_pairs_equal_a_plain_transform():
    rnd = random.Random(9)
    for n in (64, 128, 192, 640, 1500):
        samples = bytes(int(128 + 60 * math.sin(i * i / 900) + rnd.randint(-30, 30)) for i in range(n))
        times, codes = media.peak_pairs(samples)
        assert list(zip(times.tolist(), codes.tolist())) == plain(samples)


def test_arrays_are_returned_in_order_of_time(spark):
    docs = spark.createDataFrame([(1, "some words of a text " * 40), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in media.op5_rows(docs).collect()}
    assert got[1]["times"] == sorted(got[1]["times"]) and len(got[1]["times"]) == len(got[1]["codes"]) > 0
    assert got[1]["feature"].startswith(f"{len(got[1]['times'])}:") and got[2]["feature"] == got[3]["feature"]
