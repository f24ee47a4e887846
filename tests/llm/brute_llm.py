"""Plain-Python versions of the training-data operators, over lists of rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import regex

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(FOLD))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    best: dict = {}
    for k, (doc_id, _) in enumerate(rows):
        r = find(k)
        best[r] = min((v for v in (best.get(r), doc_id) if v is not None), default=None)
    return [(rows[k][0], len(sets[k]), best[find(k)] if sets[k] else rows[k][0]) for k in range(len(rows))]


def without_repeats(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256 of what is kept)."""
    texts = [WORDS.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def removed_lines(rows: list[tuple]) -> list[tuple]:
    """(row number, line number) of lines that are like an earlier one."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = [], []
    for k in order:
        for no, line in enumerate((rows[k][1] or "").split("\n") if rows[k][1] is not None else []):
            w = WORDS.findall(line)
            if not w:
                continue
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            if any(4 * len(s & t) >= 3 * len(s | t) for t in seen):
                out.append((k, no))
            seen.append(s)
    return sorted(out)


def top_k(rows: list[tuple], every: int, k: int) -> list[tuple]:
    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted(dict(reversed(fine)).items()):
        if i % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, c, strict=True)), j) for j, c in fine if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


# The placeholders' rules, as the operator's docstring states them.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|miles?|meters?|metres?|feet|inch(?:es)?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|liters?|litres?|ml"
END = r"(?![\p{L}\p{N}])"


def template(text: str) -> list[tuple]:
    """(kind, value) per token: "#" a number, "u" a unit after a number, "N" a name, "" a literal."""
    out, last, at = [], None, 0
    number = regex.compile(rf"(?<![\p{{L}}\p{{N}}])\d+(?:[.,]\d+)*+(?:(?= ?(?:{UNITS}){END})|{END})")
    unit = regex.compile(rf" ?(?:{UNITS}){END}")
    while at < len(text):
        if (m := number.match(text, at)) and (at == 0 or not regex.match(r"[\p{L}\p{N}]", text[at - 1])):
            out.append(("#", m[0], at))
            at = m.end()
            if u := unit.match(text, at):
                out.append(("u", u[0].strip().lower(), at))
                at = u.end()
            continue
        if m := regex.compile(r"[\p{L}\p{N}]+(?:['’-]+[\p{L}'’-]*)?" if text[at].isupper() else r"[\p{L}\p{N}]+").match(text, at):
            word = regex.compile(r"[\p{L}\p{N}]+").match(text, at)
            inside = at >= 2 and text[at - 1] == " " and (regex.match(r"[\p{L}\p{N},;]", text[at - 2]) or (at >= 3 and text[at - 2] == " " and regex.match(r"[\p{L}\p{N},;]", text[at - 3])))
            name = regex.compile(rf"\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]*)*{END}").match(text, at)
            if inside and name and text[at].isupper():
                out.append(("N", name[0].lower(), at))
                at = name.end()
                continue
            out.append(("", word[0].lower(), at))
            at = word.end()
            continue
        at += 1
    return [(k, v) for k, v, _ in out]


def plain(text: str) -> list[str]:
    return regex.findall(r"\p{N}+(?:[.,]\p{N}++)*+(?![\p{L}\p{N}])|[\p{L}\p{N}]+", text.lower())


def _stretches(same: list[bool], least: int) -> list[tuple]:
    out, at = [], 0
    for i, s in enumerate([*same, False]):
        if not s:
            if i - at >= least:
                out.append((at, i))
            at = i + 1
    return out


def contaminated(text: str, items: list[str], run: int = 13, literals: int = 5) -> bool:
    """Whether a text holds one of the items, by laying every item against every place of the text."""
    doc, words = template(text), plain(text)
    forms = []
    for item in items:
        tokens = plain(item)
        m = len(tokens)
        for offset in range(-m + 1, len(words)) if m >= literals else ():
            if _stretches([0 <= offset + i < len(words) and words[offset + i] == tokens[i] for i in range(m)], min(run, m)):
                return True
        both = [template(item), template("x " + item)[1:]]
        if any(sum(k == "" for k, _ in f) < literals for f in both) and m and any(words[i : i + m] == tokens for i in range(len(words))):
            return True
        forms += [f for f in both if sum(k == "" for k, _ in f) >= literals]
    for item in forms:
        m = len(item)
        twins = [f for f in forms if [k if k else v for k, v in f] == [k if k else v for k, v in item] and [f.index(v) for v in f] == [item.index(v) for v in item]]
        for offset in range(-m + 1, len(doc)):
            same = [0 <= offset + i < len(doc) and (doc[offset + i] == item[i] or (doc[offset + i][0] == item[i][0] != "")) for i in range(m)]
            for a, b in _stretches(same, min(run, m)):
                pairs = {(item[i], doc[offset + i]) for i in range(a, b) if item[i][0]}
                if sum(item[i][0] == "" for i in range(a, b)) < literals:
                    continue
                if len(pairs) == len({p for p, _ in pairs}):
                    return True
                for i in range(a, b - run + 1):
                    if any(doc[offset + i : offset + i + run] == t[i : i + run] and sum(k == "" for k, _ in t[i : i + run]) >= literals for t in twins):
                        return True
    return False


def text_statistics(text: str) -> list[float]:
    """The quality classifier's statistics of one text, counted byte by byte and word by word."""
    data = text.encode()
    words = [w.encode() for w in WORDS.findall(text)]
    lines = [line for line in re.findall(r"[^\n]*\n|[^\n]+", text)]
    n, count = max(len(data), 1), max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / count
    symbols = b"#$%&*+/<=>@[\\]^_`{}~"
    control = {*range(0, 9), *range(14, 32), 127}
    kinds = [
        sum(48 <= b < 58 for b in data), sum(65 <= b < 91 for b in data), sum(b in b".,;:!?'\"()-" for b in data), sum(b in symbols for b in data), sum(b == ord("|") for b in data),
        sum(b in control for b in data),
    ]
    return [
        math.log1p(len(data)), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in lengths) / count - mean * mean, 0)), max(lengths, default=0), *(k / n for k in kinds),
        len(set(words)) / count, sum(a == b for a, b in zip(words, words[1:])) / count, sum(any(b in symbols + b"|" for b in w) for w in words) / count, sum(x > 20 for x in lengths) / count,
        math.log1p(len(lines)), len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
    ]


def gram_buckets(text: str, bits: int = 15) -> list[int]:
    """Buckets of all n-grams of one to three characters of the folded text."""
    folded = ""
    for c in text:
        low = c.lower() if ord(c) < 0x10000 else c
        c = (low if len(low) == 1 else c) if c.isalpha() else " "
        folded += "" if c == " " and folded.endswith(" ") else c
    out = []
    for order in (1, 2, 3):
        for i in range(len(folded) - order + 1):
            h = order
            for c in folded[i : i + order]:
                h = (h ^ ord(c)) * 0x9E3779B1 % (1 << 32)
                h ^= h >> 15
            if order > 1 or folded[i] != " ":
                out.append(h >> (32 - bits))
    return out


def language_scores(train: list[tuple[str, str]], texts: list[str], smoothing: float = 0.5, buckets: int = 1 << 15) -> list[dict[str, float]]:
    """Posterior probability of every language, per text."""
    counts = {lang: collections.Counter() for _, lang in train}
    seen = collections.Counter()
    for text, lang in train:
        counts[lang].update(gram_buckets(text))
        seen[lang] += any(c.isalpha() for c in text)
    total = {lang: sum(c.values()) + smoothing * buckets for lang, c in counts.items()}
    out = []
    for text in texts:
        grams = gram_buckets(text)
        score = {lang: math.log((seen[lang] + 1) / (sum(seen.values()) + len(seen))) + sum(math.log((c[g] + smoothing) / total[lang]) for g in grams) for lang, c in counts.items()}
        top = max(score.values())
        mass = {lang: math.exp(s - top) for lang, s in score.items()}
        out.append({lang: m / sum(mass.values()) for lang, m in mass.items()})
    return out
