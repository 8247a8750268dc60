"""What the toxicity fit holds on the driver."""

import random
import tracemalloc

from marquee.llm import toxicity


def test_contexts_are_counted_in_little_memory():
    rng = random.Random(1)
    raws = [bytes(rng.choices(b"abcde ", k=4000)) for _ in range(250)]
    tracemalloc.start()
    keys, counts = toxicity._contexts(raws + raws[:20])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    g, c = toxicity.GRAM, toxicity.CONTEXT
    pad = [bytes(c) + r + bytes(c) for r in raws]
    contexts = {(r[i : i + g + 2 * c]) for r in pad for i in range(len(r) - g - 2 * c + 1)}
    want = {}
    for x in contexts:
        k = int.from_bytes(x[c : c + g], "big")
        want[k] = want.get(k, 0) + 1
    assert dict(zip(keys.tolist(), counts.tolist())) == want
    assert peak < 42 * sum(map(len, raws))
