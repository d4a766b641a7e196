"""Direct versions of two rules, for the pipeline's tests."""

import re

import xxhash


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def contaminated(text, items):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = plain(text)
    seen = {tuple(w[i : i + 10]) for i in range(len(w))}
    for t in items:
        v = plain(t)
        for i in range(max(1, len(v) - 9)) if v else ():
            run = tuple(v[i : i + 10])
            if run in seen or any(tuple(w[k : k + len(run)]) == run for k in range(len(w) - len(run) + 1)):
                return True
    return False
