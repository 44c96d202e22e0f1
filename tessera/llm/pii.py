"""Personal data: high-recall generators, boosted trees over format and context.

All work on documents is SQL expressions within a row: no shuffle and no Python.
Patterns propose spans, also overlapping ones. A span's features describe its
format (digits, separators, checksums) and the words and characters around it. A
small ensemble of regression trees, boosted on labelled snippets from a seeded
generator, scores it; thresholds calibrated on held-out snippets select what is
added to the base spans and what is marked for redaction. The snippets' features
come from the same SQL, and the trees become CASE expressions.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LOCAL = "A-Za-z0-9._%+-"
#: Base patterns, written so that Java's matcher neither recurses nor tries a run twice: possessive
#: loops where nothing after them can need what they took, and starts at the head of a run only.
BASE = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", None),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"text rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'", "forall(split(x, '[.]'), y -> length(ltrim('0', y)) <= 3 and int(right(concat('00', y), 3)) <= 255)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"text rlike '[0-9](?:[\\x20-]?[0-9]){11}'", "length(d) between 12 and 19 and luhn_check(d)"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", "length(d) between 9 and 15"),
)
#: Generators beside the base patterns: forms without the marks that those need.
MORE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{2,}+)++", r"text rlike '[(\\[{]at[)\\]}]'"),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"text rlike '[0-9]{3}[\\x20.-][0-9]{4}'"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"text rlike '[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}\\x20?[A-Z0-9]{4}'"),
)
#: Words that speak for and against a kind, looked for just before a span.
FOR = {
    "email": "mail|contact|write|reach|address|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|login|logged|adresse",
    "card": "card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|contact|reach|whatsapp|telefon|tel.fono",
    "ssn": r"ssn|social|security|tax|identity|\bid\b",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
}
AGAINST = r"version|\bv$|order|invoice|isbn|issn|serial|sku|part|model|build|ticket|tracking|ratio|score|equation|range|\bref|commit|hash"
FEATURES = ("kind", "n_digits", "n_seps", "n_kinds_seps", "size", "checks", "plausible", "near_for", "near_against", "left_plain", "right_plain", "share_digits", "distinct_digits")


def quoted(pattern: str) -> str:
    """A SQL string literal; the parser takes a backslash as an escape."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


NONE = "cast(array() as array<struct<start:int,kind:int,stop:int,word:string>>)"
#: Members of an array that are looked at together, so that work grows as their number does.
CHUNK = 64


def let(value: str, name: str, body: str) -> str:
    """body with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spans(kind: int, pattern: str, guard: str, test: str | None) -> str:
    """Array of (start, kind, stop, word) of the matches of a pattern that pass a test of x, or of its digits d.

    Starts are sums over what lies before, taken by chunks.
    """
    p, test = quoted(pattern), "true" if test is None else test
    if "d)" in test or "(d" in test:
        test = test.replace("(d)", "(regexp_replace(x, '[^0-9]', ''))")
    steps = "transform(sequence(1, size(v.m)), i -> length(v.q[i - 1]) + length(v.m[i - 1]))"
    offsets = f"aggregate(sequence(0, (size(v.l) - 1) div {CHUNK}), array(0), (acc, c) -> concat(acc, array(element_at(acc, -1) + aggregate(slice(v.l, c * {CHUNK} + 1, {CHUNK}), 0, (a, n) -> a + n))))"
    start = f"v.o[i div {CHUNK}] + aggregate(slice(v.l, (i div {CHUNK}) * {CHUNK} + 1, i % {CHUNK}), 0, (a, n) -> a + n) + length(v.q[i])"
    found = f"transform(transform(sequence(0, size(v.m) - 1), i -> named_struct('start', {start}, 'word', v.m[i])), s -> named_struct('start', s.start, 'kind', {kind}, 'stop', s.start + length(s.word), 'word', s.word))"
    kept = f"filter({found}, s -> exists(array(s.word), x -> {test}))"
    whole = let(f"named_struct('m', v.m, 'q', v.q, 'l', {steps})", "v", let(f"named_struct('m', v.m, 'q', v.q, 'l', v.l, 'o', {offsets})", "v", kept))
    return f"CASE WHEN {guard} THEN {let(f'named_struct({chr(39)}m{chr(39)}, regexp_extract_all(text, {p}, 0), {chr(39)}q{chr(39)}, split(text, {p}, -1))', 'v', f'CASE WHEN size(v.m) > 0 THEN {whole} ELSE {NONE} END')} ELSE {NONE} END"


def apart(proposals: str, base: str) -> str:
    """The proposals that overlap no base span; base is sorted by start."""
    part = f"slice({base}, c * {CHUNK} + 1, {CHUNK})"
    chunks = f"CASE WHEN size({base}) = 0 THEN array() ELSE transform(sequence(0, (size({base}) - 1) div {CHUNK}), c -> named_struct('low', {base}[c * {CHUNK}].start, 'high', array_max(transform({part}, y -> y.stop)), 'part', {part})) END"
    return let(chunks, "cs", f"filter({proposals}, s -> not exists(cs, c -> c.low < s.stop and s.start < c.high and exists(c.part, y -> s.start < y.stop and y.start < s.stop)))")


def first_come(m: str, kind: str) -> str:
    """Of an array sorted by start, the members that overlap none kept before them."""
    none = f"cast(array() as array<{kind}>)"
    begin = f"named_struct('done', cast(array() as array<array<{kind}>>), 'part', {none}, 'stop', 0)"
    step = f"CASE WHEN acc.stop > s.start THEN acc WHEN size(acc.part) < {CHUNK} THEN named_struct('done', acc.done, 'part', concat(acc.part, array(s)), 'stop', s.stop) ELSE named_struct('done', concat(acc.done, array(acc.part)), 'part', array(s), 'stop', s.stop) END"
    return f"aggregate({m}, {begin}, (acc, s) -> {step}, acc -> flatten(concat(acc.done, array(acc.part))))"


def features(s: str) -> str:
    """A struct of numbers for the candidate s (start, kind, stop, word) of a text."""
    d = f"regexp_replace({s}.word, '[^0-9]', '')"
    seps = f"regexp_replace({s}.word, '[0-9A-Za-z]', '')"
    before = f"lower(substr(text, greatest(1, {s}.start - 39), least(40, {s}.start)))"
    near = "CASE " + " ".join(f"WHEN {s}.kind = {k} THEN {before} rlike {quoted(FOR[name])}" for k, name in enumerate(KINDS)) + " ELSE false END"
    octets = f"forall(split({s}.word, '[.]'), y -> length(y) <= 3)"
    plain = f"replace({s}.word, ' ', '')"
    iban = f"length({plain}) between 15 and 34 and aggregate(split(concat(substr({plain}, 5), substr({plain}, 1, 4)), ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c rlike '[0-9]' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
    checks = f"CASE {s}.kind WHEN 2 THEN luhn_check({d}) WHEN 1 THEN {octets} WHEN 5 THEN {iban} ELSE true END"
    plausible = f"CASE {s}.kind WHEN 4 THEN not ({s}.word rlike '^(000|666|9)|-00-|-0000$') WHEN 3 THEN regexp_replace({s}.word, '^[^0-9]*', '') rlike '^[2-9]|^1[^0-9]' WHEN 0 THEN {s}.word rlike '[A-Za-z]{{2,}}$' WHEN 2 THEN {d} rlike '^[3-6]' ELSE true END"
    values = {
        "kind": f"{s}.kind", "n_digits": f"length({d})", "n_seps": f"length({seps})", "n_kinds_seps": f"size(array_distinct(split({seps}, '')))", "size": f"length({s}.word)",
        "checks": f"int({checks})", "plausible": f"int({plausible})", "near_for": f"int({near})", "near_against": f"int({before} rlike {quoted(AGAINST)})",
        "left_plain": f"int({s}.start = 0 or substr(text, {s}.start, 1) rlike '[\\\\s,;:(\\\\[\"]')", "right_plain": f"int({s}.stop >= length(text) or substr(text, {s}.stop + 1, 1) rlike '[\\\\s,;:.)\\\\]\"!?]')",
        "share_digits": f"length({d}) / length({s}.word)", "distinct_digits": f"size(array_distinct(split({d}, '')))",
    }
    return "named_struct(" + ", ".join(f"'{k}', double({values[k]})" for k in FEATURES) + ")"


def candidates() -> tuple[str, str]:
    """SQL for the base spans and for all other proposals of `text`."""
    base = [spans(KINDS.index(k), p, g, t) for k, p, g, t in BASE]
    more = [spans(KINDS.index(k), p, g, None) for k, p, g in MORE]
    return f"concat({', '.join(base)})", f"concat({', '.join(more)})"


# --- training, on the driver and on a bounded set of generated snippets


#: What people write before personal data, and before strings of a like format that aren't any.
CUES = {
    "email": ("mail", "e-mail:", "reach me at", "write to", "contact", "schreib an", "correo", "courriel :", "sent from", "cc"),
    "ip": ("ip", "ip address", "host", "from", "server at", "logged in from", "client", "adresse", "peer", "blocked"),
    "card": ("card", "credit card", "visa", "paid with", "karte", "carte", "tarjeta", "amex", "charge", "cc no."),
    "phone": ("call", "tel", "phone:", "mobile", "ring", "fax", "text me on", "telefon", "appelez", "whatsapp"),
    "ssn": ("ssn", "social security", "tax id", "ssn:", "my social is", "identity", "soc. sec. no.", "taxpayer"),
    "iban": ("iban", "account", "konto", "transfer to", "compte", "cuenta", "pay into", "bank"),
}
OTHER_CUES = ("order", "version", "invoice", "serial", "isbn", "part", "ticket", "model", "tracking", "build", "ref.", "commit", "sku", "ratio", "score", "section", "lot", "release")


def iban_of(country: str, body: str) -> str:
    """The body with the check digits that make it valid."""
    plain = "".join(str(ord(c) - 55) if c.isalpha() else c for c in body + country + "00")
    return f"{country}{98 - int(plain) % 97:02d}{body}"


def snippets(seed: int, n: int) -> list[tuple[str, int]]:
    """Labelled snippets with one candidate each: personal data (1) and strings of a like format (0)."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randint(2, 9)))
    fours = lambda x: r.choice(["", " "]).join(x[j : j + 4] for j in range(0, len(x), 4))

    def luhn(k: int, good: bool) -> str:
        head = r.choice("3456" if good or r.random() < 0.3 else "012789") + digits(k - 2)
        for last in "0123456789":
            total = sum(x if j % 2 == 0 else x * 2 - 9 * (x > 4) for j, x in enumerate(map(int, reversed(head + last))))
            if total % 10 == 0:
                return head + last
        raise AssertionError

    def candidate(kind: str, good: bool) -> str:
        if kind == "email":
            at, dot = r.choice([("@", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", "(dot)"), ("{at}", "{dot}")])
            if good:
                return f"{word()}{r.choice(['.', '_', ''])}{r.choice([word(), digits(2), ''])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'co.uk' if dot == '.' else 'io'])}"
            return f"{word()}{r.choice(['[at]', '{at}', '(at)'])}{word()}.{digits(r.randint(2, 4))}"
        if kind == "ip":
            return ".".join(str(r.randint(1, 254)) for _ in range(4)) if good else ".".join(str(r.randint(0, 12)) for _ in range(4))
        if kind == "card":
            return fours(luhn(r.choice([15, 16, 16, 16]), good)) if good else luhn(r.choice([12, 13, 14, 16, 18, 19]), good)
        if kind == "phone":
            area = r.randint(200, 999) if good else r.randint(0, 199)
            forms = [f"({area:03d}) {digits(3)}-{digits(4)}", f"{area:03d}-{digits(3)}-{digits(4)}", f"{area:03d}.{digits(3)}.{digits(4)}", f"{area:03d} {digits(3)} {digits(4)}"]
            return r.choice([*forms, f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}"] if good else forms[1:])
        if kind == "ssn":
            if good:
                return f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            return r.choice([f"{r.randint(900, 999)}-{digits(2)}-{digits(4)}", f"000-{digits(2)}-{digits(4)}", f"666-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}", f"{digits(3)}-{digits(2)}-0000", f"{digits(3)}-{digits(2)}-{digits(4)}"])
        country = r.choice(["DE", "GB", "FR", "ES", "NL", "IT"])
        return fours(iban_of(country, r.choice(["", "ABNA", "NWBK"]) + digits(r.choice([14, 16, 18])))) if good else fours("".join(r.choice("ABCDEFXZ") for _ in range(2)) + digits(2) + "".join(r.choice("ABCDEFGH0123456789") for _ in range(r.choice([12, 16]))))

    out = []
    for _ in range(n):
        kind, good = r.choice(KINDS), r.random() < 0.5
        cue = r.choice(CUES[kind]) if r.random() < 0.6 else word()
        left = cue if good else r.choice(OTHER_CUES) if r.random() < 0.7 else word()
        filler = " ".join(word() for _ in range(r.choice([0, 0, 1, 3])))
        end = r.choice(["", "", ".", ",", ")", ";", "***", "%%%", "!"])
        out.append((f"{word()} {word()} {left} {filler}{' ' if filler else ''}{candidate(kind, good)}{end} {word()} {word()}", int(good)))
    return out


def tree(rows: list[tuple], residual: list[float], hess: list[float], depth: int, own: list[int]):
    """Least-squares split of the residuals, Newton steps in the leaves."""
    g, h = sum(residual[i] for i in own), sum(hess[i] for i in own)
    if depth == 0 or len(own) < 20:
        return g / (h + 1.0)
    best = (1e-6, None, None)
    for f in range(len(FEATURES)):
        order = sorted(own, key=lambda i: rows[i][f])
        gl = hl = 0.0
        for a, b in zip(order, order[1:], strict=False):
            gl, hl = gl + residual[a], hl + hess[a]
            if rows[a][f] < rows[b][f]:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, f, (rows[a][f] + rows[b][f]) / 2)
    if best[1] is None:
        return g / (h + 1.0)
    _, f, cut = best
    return (f, cut, tree(rows, residual, hess, depth - 1, [i for i in own if rows[i][f] <= cut]), tree(rows, residual, hess, depth - 1, [i for i in own if rows[i][f] > cut]))


def value(node, row) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def boost(rows: list[tuple], labels: list[int], rounds: int, depth: int, rate: float) -> list:
    total, out = [0.0] * len(rows), []
    for _ in range(rounds):
        prob = [1 / (1 + math.exp(-x)) for x in total]
        out.append(t := tree(rows, [y - p for y, p in zip(labels, prob, strict=True)], [p * (1 - p) for p in prob], depth, list(range(len(rows)))))
        total = [x + rate * value(t, row) for x, row in zip(total, rows, strict=True)]
    return out


def sql_tree(node, s: str) -> str:
    if not isinstance(node, tuple):
        return f"{node!r}D"
    return f"CASE WHEN {s}.{FEATURES[node[0]]} <= {node[1]!r}D THEN {sql_tree(node[2], s)} ELSE {sql_tree(node[3], s)} END"


_fitted: dict[tuple, tuple] = {}


def fit(spark: SparkSession, *, n: int = 1500, rounds: int = 24, depth: int = 3, rate: float = 0.4, precision: float = 0.97, seed: int = 5) -> tuple[str, dict[str, float]]:
    """SQL of the score of features `f`, and for each kind the least score of that precision on held-out snippets."""
    key = (n, rounds, depth, rate, precision, seed)
    if key not in _fitted:
        base, more = candidates()
        data = snippets(seed, n)
        frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "i int, text string")
        every = frame.select("i", "text", F.expr(f"concat({base}, {more})").alias("c")).select("i", F.expr(f"transform(c, s -> {features('s')})").alias("f"))
        rows, labels = [], []
        for i, fs in sorted((r["i"], [tuple(x) for x in r["f"]]) for r in every.collect()):
            for x in fs[:1]:
                rows.append(x)
                labels.append(data[i][1])
        half = len(rows) * 2 // 3
        trees = boost(rows[:half], labels[:half], rounds, depth, rate)
        least = {}
        for k, name in enumerate(KINDS):
            held = sorted(((sum(rate * value(t, r) for t in trees), y) for r, y in zip(rows[half:], labels[half:], strict=True) if r[0] == k), reverse=True)
            good, cut = 0, math.inf  # none reaches the precision: nothing of the kind is added
            for m, (s, y) in enumerate(held, 1):
                good += y
                if good >= precision * m and (m == len(held) or held[m][0] < s):
                    cut = s
            least[name] = cut - 1e-9 if held else math.inf
        _fitted[key] = ("(" + " + ".join(f"{rate!r}D * ({sql_tree(t, 'f')})" for t in trees) + ")", least)
    return _fitted[key]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with its spans of personal data, in code points, ends exclusive.

    n_email, n_ip, n_card, n_phone and base_sha256 are of the base patterns. spans
    also has the proposals that score at their kind's threshold or above and overlap
    neither a base span nor an earlier added one; redact lists the spans, base or
    added, that reach the threshold. All are sorted by start, then kind (ties of both
    by stop). found has them with scores. Features of context look at the 40 characters
    before a span and at the one on either side; spans may be of any length.

    A null text counts as empty and has no span, an empty table gives an empty result;
    repeated rows are scanned each; other columns are ignored. A text and its spans are
    one row's arrays; work grows in proportion to both.
    """
    score, least = fit(docs.sparkSession)
    base, more = candidates()
    name = "CASE {s}.kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
    listed = lambda a: f"array_join(transform({a}, s -> concat_ws(':', {name.format(s='s')}, s.start, s.stop)), ',')"
    number = lambda x: f"{x!r}D" if math.isfinite(x) else "double('Infinity')"
    cut = "CASE s.kind " + " ".join(f"WHEN {k} THEN {number(least[x])}" for k, x in enumerate(KINDS)) + " END"
    scored = lambda a: f"transform({a}, s -> named_struct('start', s.start, 'kind', s.kind, 'stop', s.stop, 'score', element_at(transform(array({features('s')}), f -> {score}), 1)))"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.expr(f"array_sort({base})").alias("b"), F.expr(f"array_sort({more})").alias("m"))
    rows = rows.select("doc_id", F.expr(scored("b")).alias("b"), F.expr(f"filter({scored(apart('m', 'b'))}, s -> s.score >= {cut})").alias("m"))
    fold = first_come("m", "struct<start:int,kind:int,stop:int,score:double>")
    rows = rows.select("doc_id", "b", F.expr(f"array_sort(concat(b, {fold}))").alias("every"))
    count = lambda k: F.expr(f"cast(size(filter(b, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}")
    return rows.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(F.expr(listed("b")), 256).alias("base_sha256"), F.expr(listed("every")).alias("spans"), F.expr(listed(f"filter(every, s -> s.score >= {cut})")).alias("redact"),
        F.expr(f"transform(every, s -> named_struct('kind', {name.format(s='s')}, 'start', s.start, 'end', s.stop, 'score', s.score))").alias("found"),
    )
