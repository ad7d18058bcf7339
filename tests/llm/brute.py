"""Plain versions of the operators, for small inputs."""

import collections
import math
import re

import xxhash

FOLD = {i: i + 32 for i in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, width):
    w = SPACE_WORD.findall((text or "").translate(FOLD))
    if len(w) >= width:
        return frozenset(zip(*[w[k:] for k in range(width)]))
    return frozenset([tuple(w)] if w else [])


def ngram_join(rows, width=3, num=90, den=100):
    """(id, n_shingles, component_id) of rows (id, text), sorted."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def decontaminate(docs, items, width=13):
    """(n_words, n_hit, items) of each text."""
    windows = {}
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(FOLD))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).update([] if i is None else [str(i)])
    sizes, out = {len(x) for x in windows}, []
    for t in docs:
        w = BENCH_WORD.findall((t or "").translate(FOLD))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


def chunks(text, window=2, every=2):
    """Lines of each chunk of a text."""
    lines = text.split("\n")
    mod, base = (1 << 31) - 1, 1_000_003
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in (xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines)]
    small, out, start = [h % mod for h in signed], [], 0
    for i in range(len(lines)):
        rolled = 0
        for back in range(window - 1, -1, -1):
            rolled = (rolled * base + (small[i - back] if i >= back else 0)) % mod
        if (rolled >> 3) % every == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def line_dedup(rows, min_lines=2):
    """(id, text, n_removed) of rows (id, text) with distinct ids, sorted."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, gone = [], 0
        for c in chunks(text or ""):
            whole = "\n".join(c)
            if len(c) >= min_lines and whole in seen:
                gone += 1
                continue
            seen.add(whole)
            kept.append(c)
        out.append((i, text if text is None else "\n".join(x for c in kept for x in c), gone))
    return sorted(out, key=str)


def exact_dedup(rows):
    """(id, keep_id, group_size) of rows (id, text), sorted."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=str)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def private_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def secret_spans(text):
    order = ("assign", "access", "hex").index
    found = [("assign", *m.span()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], order(s[0])))


def padding(rows, size=2048):
    """Checks that pieces (sequence, offset, length) lie without gaps; the padding of all sequences."""
    held = collections.defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    total = 0
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
        total += 0 if math.log2(at).is_integer() else size - at
    return total


def union_find(pairs):
    """Each member of a pair, and the smallest member of its component."""
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def thue_morse(n, a="a", b="b"):
    """A word of 2^n characters and its complement: polynomial hashes modulo 2^64 take them for one."""
    word = "".join(b if bin(i).count("1") % 2 else a for i in range(1 << n))
    return word, "".join(a if c == b else b for c in word)


def alergia(strings, alpha=0.05):
    """Mean log-likelihood per symbol under the automaton that state merging learns, the slow way."""
    end = {}
    for s in strings:
        for i in range(len(s) + 1):
            end.setdefault(s[:i], [0, 0, {}])[0] += 1
        end[s][1] += 1
    # state: [passed, ended, {symbol: [state, times]}]
    for p in sorted(end, key=len, reverse=True):
        if p:
            end[p[:-1]][2][p[-1]] = [end[p], end[p][0]]
    root = end[""]
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    apart = lambda k, n, j, m: n and m and abs(k / n - j / m) > bound * (n**-0.5 + m**-0.5)

    def alike(x, y, seen):
        if x is y or (id(x), id(y)) in seen:
            return True
        seen.add((id(x), id(y)))
        if apart(x[1], x[0], y[1], y[0]):
            return False
        for c in {*x[2], *y[2]}:
            if apart(x[2].get(c, (0, 0))[1], x[0], y[2].get(c, (0, 0))[1], y[0]):
                return False
        return all(alike(x[2][c][0], y[2][c][0], seen) for c in {*x[2]} & {*y[2]})

    def fold(x, y):
        x[0] += y[0]
        x[1] += y[1]
        for c, (under, times) in y[2].items():
            if c in x[2]:
                x[2][c][1] += times
                fold(x[2][c][0], under)
            else:
                x[2][c] = [under, times]

    red = [root]
    while True:
        blue = next(((r, c) for r in red for c in sorted(r[2]) if not any(r[2][c][0] is k for k in red)), None)
        if blue is None:
            break
        r, c = blue
        state = r[2][c][0]
        into = next((k for k in red if alike(k, state, set())), None)
        if into is None:
            red.append(state)
        else:
            r[2][c][0] = into
            fold(into, state)

    def score(s):
        at, total = root, 0.0
        for c in s:
            if c not in at[2]:
                return -math.inf
            at, times, n = at[2][c][0], at[2][c][1], at[0]
            total += math.log(times / (n + 1))
        return (total + math.log((at[1] + 0.01) / (at[0] + 1))) / (len(s) + 1)

    return score


def quoted(rows):
    """What quotation linking says of rows (conv, turn, role, text)."""

    def lines_of(text):
        out = []
        for line in re.split("\r?\n", text or ""):
            at = level = 0
            while True:
                skip = at + (at < len(line) and line[at] in " \t")
                if skip < len(line) and line[skip] == ">":
                    level, at = level + 1, skip + 1
                else:
                    break
            out.append((level, line[at:].strip(" "), line))
        return out

    def passages_of(lines):
        out, before = [], (None, "")
        for level, body, _ in lines:
            if body:
                if before[1] and before[0] == level:
                    out[-1][1].append(body)
                else:
                    out.append((level, [body]))
            before = (level, body)
        fold = lambda t: re.sub("[\x20\t-\r]+", " ", t.translate(FOLD)).strip(" ")
        return [(level, t) for level, own in out if (t := fold(" ".join(own)))]

    announced = re.compile(r"(on|am|le|el)\b.*\b(wrote|schrieb|a écrit|escribió)\s*:\s*$", re.I)
    parsed = [lines_of(r[3]) for r in rows]
    passages = [passages_of(p) for p in parsed]
    first, links = {}, {}
    for (conv, turn, *_), own in zip(rows, passages):
        if conv is not None and turn is not None:
            for level, text in own:
                if level == 0:
                    first[conv, text] = min(first.get((conv, text), turn), turn)
    for (conv, turn, *_), own in zip(rows, passages):
        if conv is not None and turn is not None:
            for level, text in own:
                if level and first.get((conv, text), turn) < turn:
                    links.setdefault((conv, turn), set()).add((level, first[conv, text], text))
    up = {k: max((o for lv, o, _ in v if lv == 1), default=None) for k, v in links.items()}
    up = {k: max(o for _, o, _ in links[k]) if u is None else u for k, u in up.items()}
    out = []
    for (conv, turn, *_), lines, own in zip(rows, parsed, passages):
        at, depth = turn, 0
        while (conv, at) in up:
            at, depth = up[conv, at], depth + 1
        clean = [x for i, (level, body, x) in enumerate(lines) if not level and not (announced.match(body) and i + 1 < len(lines) and lines[i + 1][0])]
        found = links.get((conv, turn), ())
        out.append({"reply_to": up.get((conv, turn)), "root_turn": at, "depth": depth, "n_quotes": sum(lv > 0 for lv, _ in own), "n_linked": len({t for *_, t in found}), "clean_text": re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", "\n".join(clean))})
    return out


def line_runs(rows, words=50, min_lines=2):
    """(id, text, whether it lost lines) of rows (id, text) with distinct ids, once repeated chunks, shortest
    runs of more than ``words`` words and whole texts are gone; in the order of ids."""
    first, own, out = {}, {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        lines = (text or "").split("\n")
        count = [len(SPACE_WORD.findall(x)) for x in lines]
        units, at = {(0, len(lines))} if len(lines) >= min_lines else set(), 0
        for c in chunks(text or ""):
            if len(c) >= min_lines:
                units.add((at, at + len(c)))
            at += len(c)
        filled = [k for k, n in enumerate(count) if n]
        for a in range(len(filled)):
            z, total = a, 0
            while z < len(filled) and total <= words:
                total, z = total + count[filled[z]], z + 1
            if total > words:
                units.add((filled[a], filled[z - 1] + 1))
            b, total = a, 0
            while b >= 0 and total <= words:
                total, b = total + count[filled[b]], b - 1
            if total > words:
                units.add((filled[b + 1], filled[a] + 1))
        own[i] = [(a, z, tuple(lines[a:z])) for a, z in sorted(units)]
        for a, _, key in own[i]:
            first.setdefault(key, (i, a))
    for i, text in order:
        lost = set()
        for a, z, key in own[i]:
            j, at = first[key]
            if (j, at) != (i, a):
                lost |= set(range(max(a, at + z - a) if j == i else a, z))
        out.append((i, text if not lost else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost), bool(lost)))
    return out


def added_private_spans(text):
    """The kinds that anchor expansion adds: every place is tried for a scheme or a cue, without an automaton."""
    out = []
    for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.-]*(://[^\s<>\"'`{}|\\^\[\]]+)", text):
        value = m[0].rstrip(".,;:!?)")
        if len(value) > m.start(1) - m.start() + 3:
            out.append(("url", m.start(), m.start() + len(value)))
    low, free = text.translate(FOLD), {}
    gap = r"(?:\x20?(?i:no|nr|num|number|code|id)\b\.?)?\x20*[:=#]?\x20*"
    shape = {"iban": r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", "account": r"([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9A-Za-z])", "ssn": r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"}
    cues = {"iban": "iban", "ssn": "ssn", "social security": "ssn"} | dict.fromkeys(["account", "acct", "konto", "cuenta", "compte"], "account")
    for end in range(1, len(text) + 1):
        for cue, kind in cues.items():
            if low[:end].endswith(cue) and (m := re.compile(gap + shape[kind]).match(text, end)) and m.start(1) >= free.get(kind, 0):
                value = m[1]
                if kind == "iban":
                    words = value.split(" ")
                    good = (" ".join(words[:n]) for n in range(len(words), 0, -1))
                    ok = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
                    value = next((v for v in good if ok(v.replace(" ", ""))), "")
                    if len(value.replace(" ", "")) < 15:
                        continue
                free[kind] = m.start(1) + len(value)
                out.append((kind, m.start(1), free[kind]))
    order = ("url", "iban", "account", "ssn")
    return sorted(out, key=lambda s: (order.index(s[0]), s[1]))


def valleys(rows, gap_us=300_000_000):
    """(key, match_no, first_id, last_id, n_rows, sum_cents, labels) of rows (id, micros, key, kind, value)."""
    out, by_key = [], collections.defaultdict(list)
    for i, us, key, kind, value in set(rows):
        if key is not None and us is not None:
            by_key[key].append((us, i, kind, None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)))
    for key, own in by_key.items():
        own.sort(key=lambda r: (r[0], r[1]))
        number = 0

        def fits(letter, k, start):
            (us0, _, _, c0), (us, _, kind, c) = own[k - 1], own[k]
            if c is None or us - us0 > gap_us:
                return False
            if letter == "P":
                return kind == "click" and c >= own[start][3]
            return kind not in (None, "error") and c0 is not None and (c < c0 if letter == "D" else c > c0)

        def longest(letter, k, start):
            """Backtracking: letters D+ U+ P from row k on, as a string, or None."""
            if k < len(own) and letter == "P":
                return "P" if fits("P", k, start) else None
            if k >= len(own) or not fits(letter, k, start):
                return None
            for then in (letter, "U" if letter == "D" else "P"):
                if (rest := longest(then, k + 1, start)) is not None:
                    return letter + rest
            return None

        for s in range(len(own)):
            if own[s][3] is not None and (labels := longest("D", s + 1, s)) is not None:
                number += 1
                taken = own[s : s + len(labels) + 1]
                out.append((key, number, taken[0][1], taken[-1][1], len(taken), sum(r[3] for r in taken), "A" + labels))
    return sorted(out, key=str)


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of rows (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = re.compile(r"(s?(ua)+)?")
    best = {}

    def go(i, initials, inserts):
        """The least (cost, audit, lines) of the rows from i on behind these initials."""
        tail = initials[-2:] if "s" not in initials[-1:] else "s"  # what the grammar remembers
        if (i, tail, inserts) in best:
            return best[i, tail, inserts]
        ways = [(0, "", ())] if i == len(rows) and legal.fullmatch(initials) else []

        def way(cost, letter, line, then):
            # a beginning of a legal string is one that a few more turns complete
            if any(legal.fullmatch(then[1] + more) for more in ("", "a", "ua")):
                c, a, lines = go(*then)
                ways.append((cost + c, letter + a, (*line, *lines)))

        if inserts < 3:
            for role in ("user", "assistant"):
                way(3, "I", (role + ":",), (i, initials + role[0], inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            way(4, "D", (), (i + 1, initials, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                way(more, "K", (f"{role}:{text}",), (i + 1, initials + role[:1], 0))
                for other in ("user", "assistant"):
                    way(3 + more, "R", (f"{other}:{text}",), (i + 1, initials + other[0], 0))
        best[i, tail, inserts] = min(ways, key=lambda w: w[:2]) if ways else (math.inf, "", ())
        return best[i, tail, inserts]

    cost, audit, lines = go(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, list(lines)
