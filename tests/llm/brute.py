"""Plain readings of operators, from the text alone: nothing here calls the package."""

WHITE = " \t\n\x0b\x0c\r"


def sentences(text):
    """Pieces that end after a line's end or after stops and closing quotes before white space."""
    out, start, i = [], 0, 0
    while i < len(text):
        j = i + 1
        if text[i] == "\n":
            while j < len(text) and text[j] in WHITE:
                j += 1
        elif text[i] in ".!?…。！？":
            while j < len(text) and text[j] in ".!?…。！？":
                j += 1
            while j < len(text) and text[j] in "\"'”’)]":
                j += 1
            end = j
            while j < len(text) and text[j] in WHITE:
                j += 1
            if j == end:
                i = j
                continue
        else:
            i = j
            continue
        out.append(text[start:j])
        start = i = j
    return out + [text[start:]] * (start < len(text))


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def without_repeats(texts, run=2, least=20):
    """{id: text} less the passages of ``least`` words or more that repeated runs of ``run`` sentences cover."""
    first, out = {}, {}
    for i in sorted(texts):
        pieces = sentences(texts[i] or "")
        said = [(k, words(p.lower())) for k, p in enumerate(pieces) if words(p)]
        covered = [False] * len(said)
        for a in range(len(said) - run + 1):
            key = tuple(" ".join(w) for _, w in said[a : a + run])
            if first.setdefault(key, (i, a)) != (i, a):
                covered[a : a + run] = [True] * run
        gone = set()
        for a in range(len(said)):
            if covered[a] and (a == 0 or not covered[a - 1]):
                b = a
                while b < len(said) and covered[b]:
                    b += 1
                if sum(len(w) for _, w in said[a:b]) >= least:
                    gone |= {k for k, _ in said[a:b]}
        out[i] = texts[i] if texts[i] is None else "".join(p for k, p in enumerate(pieces) if k not in gone)
    return out
