"""A small corpus with planted toxic rows, near copies and secrets."""

import numpy as np

WORDS = "alpha beta gamma delta epsilon zeta theta iota kappa lambda sigma omega".split()


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 90, n), strict=True))


def corpus():
    docs, labels = [], []
    for i in range(360):
        text = _prose(i, 60)
        toxic = i % 6 == 0
        if toxic:
            text = f"{text[:100]} vileling {text[100:]} bruteling scumling"
        elif i % 17 == 1:
            text = _prose(i - 1 if (i - 1) % 6 else i + 1, 60) + " tail"
        elif i % 13 == 5:
            text += " password=hunter2hunter2 end"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None, "en", None, 0), (901, "", "en", "s1", 0)]
    return docs, labels
