"""Personal data: base patterns, and boosted trees over candidates of high-recall generators, in SQL expressions only.

Base spans (email, ip, card, phone) come from fixed patterns with checks and always stay. Three generators propose further
spans, which may overlap: obfuscated addresses (`contact`), long tokens (`secret`) and groups of digits (`id`). A
candidate's features are its format (length, digits, letters, separators, hexadecimal, known prefixes) and its context
(words just before it in four languages, quotes). For each generator gradient-boosted trees score the candidates; the score
is calibrated to a share of true candidates, and a threshold gives PRECISION on templates that the trees weren't fitted
on. Candidates above it are taken unless they overlap a base span; of candidates that overlap each other the one of the
higher calibrated score wins, then the one that begins first, then the earlier generator's. (They meet in order of their
starts: what has lost to a neighbour stays out, even if that one loses to the next.)

The trees are fitted on the driver from a table of EXAMPLES made examples a kind with fixed seed, so the model is the
same whatever the input; their features come from the same SQL expressions, and the trees become SQL expressions too. The
examples come from templates, of which half serve to fit, a quarter to calibrate, and a quarter only to be judged on.

Positions are code points, ends exclusive. Patterns use possessive repeats, which match the same strings, in linear time
and without recursion. Places of matches are running sums over the pieces between them, kept in blocks, and matches are
checked before they are placed, so the time for a text grows with its length, however many numbers it has.

Defined results: null and empty texts have no spans; texts of any length are searched whole; repeated rows give repeated
results; `find` ignores extra columns, but for kept ones, and leaves out kept ones named like its own; `redact` keeps all
columns; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import boost, calibrated, expression, margins, probability
from .common import require, without_names

EXAMPLES, PRECISION = 600, 0.98

#: Characters of a local part, and one octet of an address.
LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "contact": rf"(?<!{LOCAL}){LOCAL}++\x20?[\[(]?(?:at|AT)[\])]?\x20?[A-Za-z0-9-]++\x20?[\[(]?(?:dot|DOT)[\])]?\x20?[A-Za-z]++",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "id": r"(?<![0-9A-Za-z])[(]?[0-9][0-9\x20().-]{5,}[0-9]",
}
#: What a text needs for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "contact": "dot|DOT", "secret": "[0-9]", "id": "[0-9]"}
BASE = tuple(PATTERNS)

#: Words of a context in English, German, French and Spanish, by what they speak for.
CONTEXT = {
    "secrets": [["token", "secret", "password", "passwd", "api", "key", "auth", "bearer", "credential"], ["passwort", "kennwort", "geheim", "schluessel", "zugang"], ["passe", "jeton", "cle", "motdepasse", "acces"], ["clave", "secreto", "contrase", "acceso", "llave"]],
    "persons": [["ssn", "social", "passport", "iban", "account", "licence", "license", "tax", "insurance", "patient"], ["konto", "steuer", "ausweis", "versicherung", "reisepass"], ["compte", "passeport", "assurance", "impot", "permis"], ["cuenta", "pasaporte", "seguro", "impuesto", "dni"]],
    "contacts": [["call", "tel", "phone", "mobile", "fax", "contact", "mail", "reach", "write"], ["telefon", "handy", "anruf", "kontakt", "schreib"], ["portable", "appel", "courriel", "joindre", "ecri"], ["movil", "llama", "correo", "contacto", "escrib"]],
    "others": [["commit", "sha", "version", "isbn", "order", "date", "page", "build", "hash", "checksum", "total", "between"], ["bestellung", "seite", "datum", "fassung", "summe"], ["commande", "facture", "numero", "entre", "somme"], ["pedido", "pagina", "fecha", "suma", "folio"]],
}
FEATURES = ("length", "digits", "upper", "lower", "marks", "kinds", "hex", "prefix", "quoted", "groups", *CONTEXT)


def matched(text: Column, kind: str, pattern: str) -> Column:
    """array<string> of all matches; null where the text lacks what a match needs."""
    need = NEEDS[kind]
    return F.when(text.contains(need) if need == "@" else text.rlike(need), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


#: Entries in a block of running sums or of a list that grows.
BLOCK = 256


def with_places(rows: DataFrame, kind: str, text: Column, pattern: str, check) -> DataFrame:
    """rows with a column _k_KIND, array<struct<kind,start,end,match,before>> of the matches (column _m_KIND) that pass: what
    lies between matches tells their places. Each step is a column that the next refers to twice, so Spark doesn't repeat it."""
    m, pieces, sizes, blocks, sums = (F.col(f"_{x}_{kind}") for x in "mplbs")
    rows = rows.withColumn(f"_m_{kind}", F.when(F.size(m) > 0, m))
    rows = rows.withColumn(f"_p_{kind}", F.when(m.isNotNull(), F.split(text, pattern, -1)))
    rows = rows.withColumn(f"_l_{kind}", F.transform(m, lambda x, i: F.length(x) + F.length(F.get(pieces, i))))
    zero = F.array(F.lit(0))
    add = lambda got, x: F.array_append(got, F.element_at(got, -1) + x)
    rows = rows.withColumn(f"_b_{kind}", F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), zero, add)))
    rows = rows.withColumn(f"_s_{kind}", F.aggregate(blocks, zero, lambda got, b: add(got, F.element_at(b, -1))))

    def span(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get(sums, block) + F.get(F.get(blocks, block), i - block * BLOCK) + F.length(F.get(pieces, i))
        match = F.get(m, i)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.lower(F.right(F.get(pieces, i), F.lit(24))).alias("before"))

    some = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: check(F.get(m, i)) & (i < F.size(pieces)) & (F.size(sums) > 0))
    return rows.withColumn(f"_k_{kind}", F.coalesce(F.transform(some, span), none()))


def passing(kind: str, match: Column) -> Column:
    """The check that a base match has to pass."""
    if kind == "ip":
        return match.rlike(rf"^0*{OCTET}(?:\.0*{OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string>>")


def with_candidates(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """rows with a column _k_KIND of spans for each pattern; matches are found once, in a step of their own."""
    rows = rows.withColumns({f"_m_{k}": matched(F.col(text), k, p) for k, p in patterns.items()})
    for k, p in patterns.items():
        rows = with_places(rows, k, F.col(text), p, lambda match, k=k: passing(k, match))
    return rows.drop(*[f"_{x}_{k}" for k in patterns for x in "mplbs"])


def features(span: Column) -> list[Column]:
    """Numbers of a candidate, in the order of FEATURES."""
    m, before = span["match"], span["before"]
    without = lambda c: F.length(m) - F.length(F.regexp_replace(m, c, ""))
    flag = lambda c: c.cast("int")
    words = [flag(before.rlike(r"(?:^|[^a-z])(?:" + "|".join(x for w in of for x in w) + ")")) for of in CONTEXT.values()]
    return [
        F.length(m),
        without("[0-9]"),
        without("[A-Z]"),
        without("[a-z]"),
        without("[^A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(m, ""))),
        flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(m.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|AIza|eyJ)")),
        flag(before.rlike("[\"'=:]\\s*$")),
        F.size(F.split(m, "[^0-9]+")),
        *words,
    ]


# ---------------------------------------------------------------- examples and model


LOW, UP, DEC, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def made_examples(kind: str, n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int, int]]:
    """(text with one candidate of a generator, 1 if it is to be redacted, number of its template). Templates have their
    context in one of four languages."""
    rnd = random.Random(f"{kind} {seed}")
    some = lambda letters, a, b=0: "".join(rnd.choices(letters, k=rnd.randint(a, b or a)))
    word = lambda: some(LOW, 2, 9)
    plain = lambda: f"{word()} {word()} "

    def lead(group: str) -> str:
        return plain() + rnd.choice(rnd.choice(CONTEXT[group])) + rnd.choice([": ", " ", " = ", '="', ' is "', " no ", ' : "', " nr "])

    day = lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}"
    end = lambda: rnd.choice(["com", "org", "net", "de", "io", "fr", "es"])
    name = lambda: word() + rnd.choice(["", "." + word(), some(DEC, 1, 3)])
    digest = lambda: some(HEX, rnd.choice([31, 39, 63]))
    years = lambda: f"{rnd.randint(1900, 2030)} - {rnd.randint(1900, 2030)}"
    shapes = [  # of numbers; what they stand for shows in the words before them
        lambda: f"{some(DEC, 3)}-{some(DEC, 2)}-{some(DEC, 4)}",
        lambda: f"({some(DEC, 3)}) {some(DEC, 3)}-{some(DEC, 4)}",
        lambda: some(DEC, 8, 12),
        lambda: f"{some(DEC, 3)}-{some(DEC, 3)}-{some(DEC, 4)}",
        lambda: f"{some(DEC, 2)} {some(DEC, 6)} {some(DEC, 3)}",
        lambda: f"0{some(DEC, 3)} {some(DEC, 6)}",
        lambda: f"{some(DEC, 4)} {some(DEC, 4)} {some(DEC, 4)}",
        lambda: f"0{some(DEC, 1)}{some(DEC, 2, 3)}.{some(DEC, 3)}.{some(DEC, 2, 3)}",
    ]
    yes = {
        "contact": [
            lambda: plain() + f"{name()} at {word()} dot {end()}",
            lambda: lead("contacts") + f"{name()} at {word()} dot {end()}",
            lambda: plain() + f"{name()} [at] {word()} [dot] {end()}",
            lambda: lead("contacts") + f"{name()} [at] {word()} [dot] {end()}",
            lambda: plain() + f"{name()}(at){word()}(dot){end()}",
            lambda: lead("contacts") + f"{name()} (at) {word()} (dot) {end()}",
            lambda: plain() + f"{name()} AT {word()} DOT {end()}",
            lambda: lead("contacts") + f"{name()}[at]{word()}[dot]{end()}",
        ],
        "secret": [
            lambda: plain() + rnd.choice(["AKIA", "ASIA"]) + some(UP + DEC, 15) + some(DEC, 1),
            lambda: plain() + rnd.choice(["ghp_", "gho_"]) + some(LOW + UP + DEC, 35) + some(DEC, 1),
            lambda: lead("secrets") + digest() + some(DEC, 1),
            lambda: lead("secrets") + some(LOW + UP + DEC, 20, 48) + some(DEC, 2),
            lambda: plain() + rnd.choice(["sk_", "sk-", "pk_"]) + some(LOW + UP + DEC, 20, 40) + some(DEC, 1),
            lambda: lead("secrets") + digest() + some(DEC, 1),
            lambda: plain() + rnd.choice(["xoxb-", "AIza", "eyJ"]) + some(LOW + UP + DEC, 24, 40) + some(DEC, 1),
            lambda: lead("secrets") + digest() + some(DEC, 1),
        ],
        "id": [lambda shape=shape: lead(rnd.choice(["persons", "contacts"])) + shape() for shape in shapes],
    }[kind]
    no = {
        "contact": [lambda w=w: plain() + f"{word()} at {word()} dot {w}{some(LOW, 1, 4)}" for w in ("product", "matrix", "notation", "plot", "print", "ted", "line", "size")],
        "secret": [
            lambda: plain() + "-".join(word() for _ in range(rnd.randint(3, 6))) + "-" + some(DEC, 1, 4),
            lambda: lead("others") + digest() + some(DEC, 1),
            lambda: plain() + some(DEC, 16, 24),
            lambda: plain() + f"{day()}_{some(DEC, 6)}",
            lambda: rnd.choice([plain(), lead("others")]) + "".join(some(LOW, 5, 9).title() for _ in range(rnd.randint(3, 5))) + some(DEC, 1, 3),
            lambda: plain() + rnd.choice("=-_") * rnd.randint(16, 40) + some(DEC, 1),
            lambda: plain() + "/".join(word() for _ in range(rnd.randint(3, 6))) + "/" + some(DEC, 2),
            lambda: plain() + some(LOW, 15, 24) + some(DEC, 1, 3),
        ],
        "id": [lambda shape=shape: rnd.choice([plain(), lead("others")]) + rnd.choice([shape, shape, day, years])() for shape in shapes],
    }[kind]
    out = []
    for k in range(n):
        label, template = k % 2, k // 2 % len(yes)
        text = (yes if label else no)[template]()
        out.append((text + rnd.choice(["", ".", '"', " " + word()]), label, template))
    return out


_fitted: dict[str, dict] = {}
#: Which templates serve to calibrate, and which only to be judged on; the others serve to fit.
CALIBRATE, JUDGE = (2, 3), (5, 6)


def fitted(spark: SparkSession) -> dict[str, dict]:
    """For each generator trees, limit, calibration (slope, shift), and precision and recall on templates that were neither
    fitted nor calibrated on."""
    if not _fitted:
        for kind, pattern in GENERATORS.items():
            listed = json.dumps([{"t": t, "y": y, "g": g} for t, y, g in made_examples(kind)])
            rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(listed), "array<struct<t:string,y:int,g:int>>")).alias("k", "e"))
            rows = with_candidates(rows.select("k", "e.t", "e.y", "e.g"), "t", {kind: pattern})
            spans = rows.select("k", "y", "g", F.explode(f"_k_{kind}").alias("s"))
            got = np.array(spans.select("k", "y", "g", *features(F.col("s"))).orderBy("k", "s.start").collect(), float)
            y, group, x = got[:, 1], got[:, 2], got[:, 3:]
            second, last = np.isin(group, CALIBRATE), np.isin(group, JUDGE)
            trees = boost(x[~second & ~last], y[~second & ~last])
            scores = margins(trees, x)
            limit = calibrated(scores[second], y[second], PRECISION)
            taken, true = scores[last] >= limit, y[last] > 0
            _fitted[kind] = {"trees": trees, "limit": limit, "calibration": probability(scores[second], y[second]), "precision": float(true[taken].mean()) if taken.any() else 0.0, "recall": float(taken[true].mean())}
    return _fitted


# ---------------------------------------------------------------- operators


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, base, spans): arrays of struct<kind,start,end>, base kinds as listed, then the others, each by start."""
    require(docs, id_col, text_col, *keep)
    keep = tuple(c for c in keep if c != id_col)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keep = tuple(without_names(list(keep), "base", "spans"))
    model = fitted(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)])
    rows = with_candidates(rows, "_text", PATTERNS | GENERATORS)

    def scored(kind: str, rank: int) -> Column:
        """Accepted candidates as struct<start, rank, score, end>; score is the calibrated share of true ones."""
        m = model[kind]
        slope, shift = m["calibration"]
        each = F.transform(F.col(f"_k_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), expression(m["trees"], features(s)).alias("score"), s["end"].alias("end")))
        some = F.filter(each, lambda s: s["score"] >= F.lit(m["limit"]))
        return F.transform(some, lambda s: F.struct(s["start"], s["rank"], F.round(1 / (1 + F.exp(-(s["score"] * slope + shift))), 9).alias("score"), s["end"]))

    rows = rows.withColumn("_base", F.concat(*[F.col(f"_k_{k}") for k in BASE]))
    rows = rows.withColumn("_more", F.concat(*[F.when(F.size(f"_k_{k}") > 0, scored(k, 1 + i)).otherwise(F.array().cast(SWEPT)) for i, k in enumerate(GENERATORS)]))
    fixed = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), F.lit(2.0).alias("score"), s["end"].alias("end")))
    rows = rows.withColumn("_won", F.when(F.size("_more") > 0, swept(F.array_sort(F.concat(fixed, F.col("_more"))))).otherwise(F.array().cast(SWEPT)))
    slim = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def added(kind: str, rank: int) -> Column:
        mine = F.filter("_won", lambda s: s["rank"] == rank)
        return F.transform(mine, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], slim.alias("base"), F.concat(slim, *[added(k, 1 + i) for i, k in enumerate(GENERATORS)]).alias("spans"))


SWEPT = "array<struct<start:int,rank:int,score:double,end:int>>"


def swept(spans: Column) -> Column:
    """Of spans in order of start (rank 0: base), the candidates that overlap no base span and lose to none they overlap. One
    walk: the last candidate is pending until the next span shows whether it stays; what stays gathers in blocks."""
    nothing, empty = F.lit(None).cast(SWEPT[6:-1]), F.array().cast(SWEPT)
    zero = F.struct(F.array().cast(f"array<{SWEPT}>").alias("blocks"), empty.alias("last"), nothing.alias("pending"), F.lit(0).alias("covered"))

    def kept(acc: Column, keep: Column) -> tuple[Column, Column]:
        """The blocks and the last one, with the pending span if it is to be kept."""
        full = keep & (F.size(acc["last"]) >= BLOCK)
        blocks = F.when(full, F.array_append(acc["blocks"], acc["last"])).otherwise(acc["blocks"])
        last = F.when(full, F.array(acc["pending"])).when(keep, F.array_append(acc["last"], acc["pending"])).otherwise(acc["last"])
        return blocks, last

    def step(acc: Column, s: Column) -> Column:
        base, hidden = s["rank"] == 0, s["start"] < acc["covered"]
        meets = acc["pending"].isNotNull() & (s["start"] < acc["pending"]["end"])
        blocks, last = kept(acc, ~base & ~hidden & acc["pending"].isNotNull() & ~meets)
        after = F.when(base, F.when(meets, nothing).otherwise(acc["pending"])).when(hidden | (meets & (s["score"] <= acc["pending"]["score"])), acc["pending"]).otherwise(s)
        covered = F.when(base, F.greatest(acc["covered"], s["end"])).otherwise(acc["covered"])
        return F.struct(blocks.alias("blocks"), last.alias("last"), after.alias("pending"), covered.alias("covered"))

    def finish(acc: Column) -> Column:
        blocks, last = kept(acc, acc["pending"].isNotNull())
        return F.concat(F.flatten(blocks), last)

    return F.aggregate(spans, zero, step, finish)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, found spans in the text replaced by [KIND]; of overlapping spans the first, then the longest, is shown."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    plain = docs.select(docs[id_col].alias("_of"), docs[text_col].alias("_body"), *[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    rows = find(plain, "_of", "_body", keep=("_body", *names))
    body = F.col("_body")
    inner = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc, s):
        free = s["start"] >= acc["at"]
        out = F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        full = free & (F.size(acc["out"]) >= BLOCK)
        blocks = F.when(full, F.array_append(acc["blocks"], F.array_join(acc["out"], ""))).otherwise(acc["blocks"])
        last = F.when(full, out).when(free, F.concat(acc["out"], out)).otherwise(acc["out"])
        return F.struct(F.when(free, -s["back"]).otherwise(F.greatest(acc["at"], -s["back"])).alias("at"), blocks.alias("blocks"), last.alias("out"))

    strings = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("at"), strings.alias("blocks"), strings.alias("out"))
    clean = F.aggregate(inner, zero, step, lambda acc: F.concat(F.array_join(acc["blocks"], ""), F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))))
    return rows.select(*[(F.when(F.size("spans") > 0, clean).otherwise(body) if c == text_col else F.col(n)).alias(c) for c, n in zip(docs.columns, names)])
