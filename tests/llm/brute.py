"""Plain Python versions of the operators' rules, and small tables to try them on."""

import collections
import hashlib
import re

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "kept boolean, node int, size string, n_words string, base string, hits int")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from here today"


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows."""
    rows = [
        (1, SENTENCE, "en", "a"), (1, SENTENCE, "en", "a"),          # a repeated row
        (2, SENTENCE, "en", "b"), (3, None, "en", "a"), (4, "", "en", None), (5, " \n\t ", None, "b"),
        (None, SENTENCE + " again", "en", "a"), (None, None, None, None), (6, LONG, "en", "a"),
        (7, "été où ça " * 30, "fr", "b"), (8, "12 34 $$ %%", "en", "b"), (9, "\x00 ퟿ 😀 ſK", "de", "c"),
        (10, "one\ntwo\n\n" + SENTENCE + "\n" + SENTENCE, "en", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), True, 1, "x", "y", "z", 0) for r in rows]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def edge_table(spark):
    return table(spark, edge_rows())


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def secrets(text):
    """(kind, start, end) by the contract's patterns as they are written there."""
    text, out = text or "", []
    rules = (("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
              r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
             ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    for order, (kind, pattern) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if len(m.group(2 if kind == "assign" else 0)) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def shingle_set(text, size):
    w = (text or "").translate(ASCII_LOWER)
    w = plain_words(w)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_components(docs, size, percent=80):
    """doc_id -> (set size, smallest doc_id of its component); ids are unique."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    of = collections.defaultdict(set)
    for i in ids:
        for s in sets[i]:
            of[s].add(i)
    for i in ids:
        for j in {j for s in sets[i] for j in of[s] if j < i}:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i) if sets[i] else i) for i in sets}


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = plain_words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if plain_words(line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    repeated = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def phrase_places(text):
    """(n_words, sorted (start, label) of the base phrases)."""
    w, out = alnum_words(text), []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"),
                          ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def contamination(text, items):
    """(n_words, n_hit, item ids as sorted strings) by comparing every window."""
    w, hit, found = alnum_words(text), set(), set()
    for item_id, item in items:
        v = alnum_words(item)
        if not v or item_id is None:
            continue
        n = min(10, len(v))
        wins = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    """Source -> target by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = budget * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bytes_lower(text):
    return (text or "").translate(ASCII_LOWER)
