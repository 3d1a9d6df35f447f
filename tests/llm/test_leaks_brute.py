"""Benchmark leaks against a plain finder over random items with numbers, units and names."""

from __future__ import annotations

import functools
import random

import regex

from fieldwise.llm import decontaminate as d

CAPITAL = regex.compile(r"\p{Lu}\p{Ll}+")


@functools.cache
def plain_tokens(text):
    """(kind, value) of each token, by looking at each run of letters and its neighbours."""
    out, number_end = [], -1
    for m in regex.finditer(r"(?<![\p{L}\p{N}])\p{Nd}+(?:[.,:/]\p{Nd}+)*|\p{L}+", text or ""):
        w, before, behind = m.group(), text[max(m.start() - 2, 0) : m.start()], text[m.end() : m.end() + 1]
        if w[0].isdigit():
            out.append(("number", w))
            number_end = m.end()
            continue
        loose = not regex.match(r"\p{N}", behind)
        capital = CAPITAL.fullmatch(w) and loose and not (before and regex.match(r"[\p{L}\p{N}]", before[-1]))
        if out and out[-1][0] == "number" and not text[number_end : m.start()].strip() and w.lower() in d.UNITS and loose:
            kind = "unit"
        elif capital:
            kind = "name" if regex.search(r"[\p{Ll},;] $", before) else "opener"
        else:
            kind = "word"
        out.append((kind, w.lower()))
    return out


def read(token, form):
    kind, value = token
    if kind in ("number", "unit"):
        return f"<{kind}>"
    hidden = {d.WITHIN: ("name",), d.ALL: ("name", "opener"), d.NONE: ()}[form]
    return "<name>" if kind in hidden else value


def literals(tokens, form):
    return len({r for r in (read(t, form) for t in tokens) if not r.startswith("<")})


def consistent(values):
    seen = {}
    return all(seen.setdefault(q, x) == x for q, x in values)


def held(doc, item, n=d.WINDOW):
    doc, item = plain_tokens(doc), plain_tokens(item)
    if not item:
        return False
    size = min(n, len(item))
    rich = [at for at in range(len(item) - size + 1) if literals(item[at : at + size], d.WITHIN) >= d.MIN_LITERALS]
    if not rich:
        bare = [(k in ("number", "unit"), v) for k, v in item]
        return any([(k in ("number", "unit"), v) for k, v in doc[i : i + len(item)]] == bare for i in range(len(doc)))
    for form in d.FORMS:
        index = {at: [read(t, form) for t in item[at : at + size]] for at in rich if literals(item[at : at + size], form) >= d.MIN_LITERALS}
        lines = {}
        for i in range(len(doc) - size + 1):
            window = [read(t, form) for t in doc[i : i + size]]
            for at in (at for at, w in index.items() if w == window):
                lines.setdefault(i - at, set()).add(at)
        covered = set().union(*lines.values()) if lines else set()
        enough = len(rich) * d.MIN_COVER
        told = {}
        for offset, ats in lines.items():
            places = {at + k for at in ats for k in range(size)}
            if len(covered) < enough and len(places) < d.PASSAGE:
                continue
            slots = {p: (item[p][1], doc[p + offset][1]) for p in places if read(item[p], form) in ("<number>", "<name>")}
            told[offset] = (ats, set(slots.values()))
            words = [p for p in range(len(item)) if not read(item[p], form).startswith("<")]
            for a, b in zip(words, words[d.PASSAGE - 1 :], strict=False):
                run = range(a, b + 1)
                if places.issuperset(run) and consistent(slots[p] for p in run if p in slots):
                    return True
        chains, last = [], None
        for offset in sorted(told):
            if last is None or offset - last > d.NEAR:
                chains.append([])
            chains[-1].append(offset)
            last = offset
        for group in [*([o] for o in told), *chains, list(told)]:
            if group and len(set().union(*(told[o][0] for o in group))) >= enough and consistent(set().union(*(told[o][1] for o in group))):
                return True
    return False


def test_leaks_are_those_of_a_plain_finder(spark):
    r = random.Random(29)
    names, vocabulary = ["Anna", "Peter", "Maria", "Tom", "Ines"], ["".join(r.choices("abcdefghiklmnorstu", k=r.randrange(2, 9))) for _ in range(120)]

    def sentence():
        out = [r.choice([*names, *(w.capitalize() for w in vocabulary)])]
        for _ in range(r.randrange(4, 14)):
            out.append(r.choice([*names, str(r.randrange(2, 60)), f"{r.randrange(2, 60)} km", "3.50 dollars", *vocabulary, *vocabulary]))
        return " ".join(out) + r.choice([".", "?", ", then"])

    def edited(text):
        ws = text.split(" ")
        for _ in range(r.randrange(4)):
            k = r.randrange(len(ws))
            ws[k : k + r.randrange(2)] = [r.choice([r.choice(vocabulary), str(r.randrange(2, 60)), r.choice(names)])]
        text = " ".join(ws)
        a, b = r.sample(names, 2)
        return r.choice([text, text.replace(a, b), text.replace("12", "47"), text.lower(), text.upper(), text.title(), " ".join(ws[: len(ws) // 2]), " ".join(ws[len(ws) // 3 :])])

    items = [" ".join(sentence() for _ in range(r.randrange(1, 5))) for _ in range(25)] + ["12 + 15 = ?", "Anna 7 km", "what is 3 times 4", "", "?!"]
    docs = [None, "", "12 15", "so 12 and 15", "anna 7 km", "anna 8 km", "What is 3 times 4, what is 4 times 3", " ".join(sentence() for _ in range(200))]
    for item in items[:25] * 3:
        docs.append(" ".join([sentence(), edited(item), sentence(), *([edited(r.choice(items[:25]))] if r.random() < 0.3 else [])]))
    docs += docs[8:12]
    found = d.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    expected = {(i, k) for i, t in enumerate(docs) for k, item in enumerate(items) if held(t, item)}
    assert got == expected and 40 < len(got) < len(docs) * 2
