"""Secret scan with a random forest against false positives (operator 3, native).

A candidate is a maximal run of 16 or more characters ``A-Za-z0-9_+/-`` (with
``=`` at its end) that holds a digit; or, whatever its length and characters, the
value that is assigned to a word naming a secret (``password = ...``), or the
password in ``scheme://user:password@host``.  Everything runs as DataFrame expressions in the JVM: candidates,
their places and contexts come from one split and one extract of the text, the
features below are SQL expressions, and the forest (fitted by Spark ML) is
turned into CASE expressions, so that a document is scanned, judged and redacted
in its own row, without a shuffle.

Features: length, distinct characters, shares of digits, capitals and small
letters, transitions between letters and digits and between cases, vowels,
coverage by common words, hexadecimal form, lying in a path, neighbouring words
that speak for a secret or against one, assignment and quotes, placeholders,
literals, other signs and known prefixes.

The forest learns from labelled findings (candidate, before, after, label).  A
caller may pass its own; ``labelled_findings`` makes ``FINDINGS`` rows from
templates of true secrets and of usual false alarms.  That number bounds the
training alone; every text is scanned whole.

Edge cases: null or empty text has no candidates and stays as it is; repeated
rows and null doc_ids are kept row by row; overlapping does not occur; an empty
table gives no rows; columns of ``docs`` other than text are passed through.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import materialize

#: Words that name a secret, as a pattern (fixed values).
NAMES = "token|secret|pass(?:word|wd|phrase|code)?|pwd|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|auth|bearer|credentials?"
ASSIGN = r"[\"'`]?\s{0,3}(?::=|=>|[=:])\s{0,3}[\"'`]?"
RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}"
VALUE = rf"(?<=[=:\s\"'`])(?<=(?:(?i:{NAMES})){ASSIGN})(?<!\w[\"'`])[^\s\"'`,;=]++"
PASSWORD = r"(?<=:)(?<=://[^\s/:@]{1,40}:)[^\s/@\"']++(?=@)"
#: With the assigned values, which only texts that pass ``ASSIGNED`` can hold.
CANDIDATE = f"{PASSWORD}|{VALUE}|{RUN}"
ASSIGNED = rf"(?i:{NAMES}){ASSIGN}[^\s\"'`,;=]|://[^\s/:@]{{1,40}}:[^\s/@]+@"
CONTEXT = 40
THRESHOLD = 0.5
REDACTED = "[SECRET]"
FINDINGS = 8000
#: Candidates that are placed together.
PLACED = 256
TREES, DEPTH, SEED = 24, 7, 20260

#: Common words that names, paths and sentences are made of (fixed values).
WORDS = "the and ing ion ent for tion with from this that have page site data file name user home list test main lib src app web com net org http www get set new old big max min log out end start stop time date year report final version release build server client local index content image video style script table field value state group order item price total north south east west international conference"
FOR = f"(?i)({NAMES})"
LITERAL = "(?i)^\\W*(none|null|nil|true|false|string|str|text|int|bool|required|optional|undefined|default|empty|hidden|redacted|removed|see|the|is|was|and|or|for|to|in|of|on|by|no|yes|n/a|tbd|todo)\\W*$"
MADE = "^[<\\[{(%$*]|[(\\[{]|[*.]{3,}|^(os|env|process|config|settings|self|this|get|vars?)[._(]"
AGAINST = "(?i)(commit|sha-?\\d*|md5|checksum|digest|hash|uuid|guid|version|revision|build|isbn|card|phone|account|order|invoice|example|sample)\\W*$"
PLACEHOLDER = "(?i)x{4,}|(.)\\1{5,}|your|here|example|sample|dummy|changeme|placeholder|12345678"
PREFIX = "^(AKIA|ASIA|ghp_|gho_|ghs_|sk_live_|xox[abp]-|AIza|glpat-|eyJ)"
VALUE_OPENS = "[=:]>?\\s{0,3}[\"'`]?$|[\"'`]$"


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    dictionary = "|".join(sorted(WORDS.split(), key=lambda w: (-len(w), w)))
    return {
        "length": n.cast("double"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "small": share("[a-z]"),
        "kinds": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "cases": share("[A-Z](?=[a-z])|[a-z](?=[A-Z])"),
        "vowels": share("(?i)[aeiou]"),
        "words": 1 - F.length(F.regexp_replace(F.lower(c), dictionary, "")) / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "signs": share("[_+/=-]"),
        "path": flag(before.rlike("(/|\\\\|://\\S*)$") | (F.regexp_count(c, F.lit("/[a-z]")) >= 2)),
        "for": flag(before.rlike(FOR)),
        "against": flag(before.rlike(AGAINST)),
        "opens": flag(before.rlike(VALUE_OPENS)),
        "closes": flag(after.rlike("^[\"'`]")),
        "placeholder": flag(c.rlike(PLACEHOLDER)),
        "prefix": flag(c.rlike(PREFIX)),
        "number": flag(c.rlike("^[0-9-]+$")),
        "others": share("[^A-Za-z0-9_+/=-]"),
        "assigned": flag(before.rlike(f"({FOR}){ASSIGN}$")),
        "of_user": flag(before.rlike("://[^\\s/:@]{1,40}:$") & after.startswith("@")),
        "literal": flag(c.rlike(LITERAL)),
        "made": flag(c.rlike(MADE)),
        "letters": flag(c.rlike("^[A-Za-z]?[a-z]*[.:!?)]*$")),
        "classes": (flag(c.rlike("[a-z]")) + flag(c.rlike("[A-Z]")) + flag(c.rlike("[0-9]")) + flag(c.rlike("[^A-Za-z0-9]"))),
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Findings made from templates: candidate, before, after, label."""
    kind, salt = F.col("id") % 32, F.col("id").cast("string")
    digest = F.sha2(salt, 256)
    number = F.regexp_replace(F.sha2(F.concat(F.lit("n"), salt), 256), "[a-f]", "")
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    pick = lambda values, seed: F.element_at(F.split(F.lit("\x01".join(values)), "\x01"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))) + 1).cast("int"))
    word = lambda seed: pick(WORDS.split(), seed)
    size = (F.pmod(F.xxhash64("id"), F.lit(33)) + 24).cast("int")
    cut = lambda text: text.substr(F.lit(1), size)
    ask = pick(["token = ", "secret: ", "api_key=", "PASSWORD = ", "Authorization: Bearer ", "access-key : ", "client_secret => ", "auth_token: "], 1)
    prose = F.concat(word(2), F.lit(" "), word(3), pick([" ", ". ", ", ", "\n", " the "], 4))
    none = pick(["commit ", "sha256: ", "md5 = ", "checksum ", "uuid: ", "etag hash ", "revision ", "digest: "], 5)
    quote = pick(["\"", "'", ""], 6)
    slug = F.concat_ws("-", word(7), word(8), word(9), F.col("id") % 2000)
    short = (F.pmod(F.xxhash64("id", F.lit(40)), F.lit(9)) + 8).cast("int")
    signed = F.translate(mixed.substr(F.lit(1), short), "aeioAEIOt5", "@!#$%^&*?~")
    capital = F.concat(F.upper(word(30).substr(1, 1)), word(30).substr(2, 20))
    weak = F.concat(capital, pick(["", "_", "-", "@", "."], 31), F.col("id") % 900 + 10, pick(["", "!", "#", "$", "?"], 32))
    random_letters = F.translate(mixed.substr(F.lit(1), size), "0123456789", "qwzxkvjpyb")
    call = F.concat(pick(["os.environ[", "get_secret(", "config.", "${", "<", "{{", "process.env.", "[", "$(", "%("], 33), F.upper(word(34)), pick(["]", ")", "", "}", ">", "}}", "_KEY", "]"], 35))
    true = (kind < 8) | kind.between(16, 23)
    candidate = (
        F.when(kind.isin(0, 1), cut(digest)).when(kind == 2, F.upper(cut(digest))).when(kind.isin(3, 4), cut(mixed))
        .when(kind == 5, F.concat(F.lit("AKIA"), F.upper(mixed.substr(1, 16)))).when(kind == 6, F.concat(F.lit("ghp_"), mixed.substr(1, 36)))
        .when(kind == 7, F.concat(F.lit("sk_live_"), mixed.substr(1, 24))).when(kind.isin(8, 9), number.substr(F.lit(1), F.pmod(size, F.lit(6)) + 16))
        .when(kind == 10, cut(digest)).when(kind == 11, slug).when(kind == 12, F.concat_ws("/", word(10), word(11), word(12), slug))
        .when(kind == 13, F.concat(pick(["your_api_key_here_", "xxxxxxxxxxxxxxxx", "example_token_", "placeholder-secret-"], 13), F.col("id") % 10))
        .when(kind == 14, F.concat_ws("_", word(14), word(15), word(16), word(17), F.col("id") % 100)).when(kind == 15, F.concat(word(18), word(19), word(20), word(21), F.col("id") % 3000))
        .when(kind.isin(16, 17, 18), signed).when(kind.isin(19, 20), weak).when(kind == 21, random_letters).when(kind.isin(22, 23), F.when(F.col("id") % 3 == 0, signed).when(F.col("id") % 3 == 1, weak).otherwise(mixed.substr(F.lit(1), short)))
        .when(kind.isin(24, 25), pick("none null true false string required optional undefined default empty hidden redacted see the is n/a TBD None NULL True".split(), 36)).when(kind.isin(26, 27), call)
        .when(kind == 28, pick(["********", "xxxxxxxx", "changeme", "your-password", "example123", "<password>", "...", "your_token_here", "dummy"], 37)).when(kind == 29, F.concat(pick(["", "my", "un", "re"], 38), word(39), pick(["", "ing", "ed", "s"], 41), pick(["", ".", "!", ":", ")"], 42)))
        .when(kind == 30, F.concat(capital, word(43))).otherwise((F.col("id") % 5000).cast("string"))
    )
    quoted = true & (kind < 5) | kind.isin(13)
    given = kind >= 16
    name = pick(["password = ", "passwd: ", "pwd=", "secret: ", "api_key = ", "auth_token => ", "PASSWORD=", "access_key: ", "passphrase: ", "db_password := ", "\"password\": "], 44)
    open_ = pick(["\"", "'", "", ""], 45)
    of_user = kind.isin(22, 23)
    before = F.when(of_user, F.concat(prose, pick(["https://", "postgres://", "ftp://", "redis://"], 46), word(47), F.lit(":"))).when(given, F.concat(prose, name, open_)).when(quoted | true & (F.pmod(F.xxhash64("id", F.lit(22)), F.lit(2)) == 0), F.concat(prose, ask, F.when(quoted, quote).otherwise(""))).when(kind == 10, F.concat(prose, none)).when(kind == 12, F.concat(prose, pick(["/", "https://www.", "./", "C:\\"], 23))).otherwise(prose)
    after = F.when(of_user, F.concat(F.lit("@"), word(48), F.lit(".com/"))).when(given, F.concat(open_, pick([" ", "\n", ", ", ";"], 49), word(24))).when(quoted, F.concat(quote, F.lit(" "), word(24))).otherwise(F.concat(F.lit(" "), word(24)))
    made = spark.range(0, rows, 1, 1).select(candidate.alias("candidate"), before.alias("before"), after.alias("after"), true.cast("double").alias("label"), given.alias("given"))
    return made.filter(F.col("candidate").rlike("^[A-Za-z0-9_+/=-]{16,}$") | F.col("given") & (F.length("candidate") > 0)).drop("given")


def fit_forest(findings: DataFrame) -> list[str]:
    """One SQL expression per tree over the struct ``f`` of features (1: secret)."""
    columns = features(F.col("candidate"), F.col("before"), F.col("after"))
    names = list(columns)
    table = materialize(findings, "findings").select("label", *[c.alias(k) for k, c in columns.items()])
    table = materialize(table, "features")  # training reads it several times
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    model = forest.fit(VectorAssembler(inputCols=names, outputCol="features").transform(table))
    return [tree_sql(tree.toDebugString, names) for tree in model.trees]


def tree_sql(described: str, names: list[str]) -> str:
    lines = iter([x.strip() for x in described.splitlines()[1:] if x.strip()])

    def node() -> str:
        line = next(lines)
        if found := re.fullmatch(r"Predict: (\S+)", line):
            return found[1]
        found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        next(lines)  # the matching Else
        return f"CASE WHEN f.`{names[int(found[1])]}` <= {found[2]}D THEN {left} ELSE {node()} END"

    return node()


def scan_documents(docs: DataFrame, trees: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``findings`` (start, end, score; end exclusive, in code
    points) and ``redacted`` (the text with secrets replaced)."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    signs = text.contains("=") | text.contains(":")  # a cheap look before the patterns
    wide = F.coalesce(signs & text.rlike(ASSIGNED), F.lit(False))
    has = F.coalesce(wide | text.rlike(RUN), F.lit(False))
    hits = lambda pattern: F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = lambda pattern: F.split(text, pattern, -1)
    cut = docs.withColumns({c: F.when(wide, f(CANDIDATE)).when(has, f(RUN)).otherwise(none) for c, f in (("_hits", hits), ("_between", between))})

    def judged(hit: Column, at: Column) -> Column:
        before, after = F.element_at("_between", at + 1), F.element_at("_between", at + 2)
        near = features(hit, F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT)))
        return F.struct(hit.alias("hit"), at.alias("at"), F.struct(*[c.cast("double").alias(k) for k, c in near.items()]).alias("f"))

    described = cut.withColumn("_described", F.transform("_hits", judged))
    votes = " + ".join(f"({t.replace('f.`', 'x.f.`')})" for t in trees)
    scored = described.withColumn("_scored", F.expr(f"transform(_described, x -> named_struct('hit', x.hit, 'at', x.at, 'score', cast({votes} as double) / {len(trees)}))"))
    # Places are sums of lengths: within runs of PLACED candidates, then over the runs,
    # as an array that grows by one is copied each time.
    run = (
        "aggregate(slice(_scored, b * {n} + 1, {n}), named_struct('at', 0L, 'all', cast(array() as array<struct<start:bigint,end:bigint,score:double>>)),"
        " (a, x) -> named_struct('at', a.at + length(element_at(_between, x.at + 1)) + length(x.hit), 'all',"
        " array_append(a.all, named_struct('start', a.at + length(element_at(_between, x.at + 1)), 'end', a.at + length(element_at(_between, x.at + 1)) + length(x.hit), 'score', x.score))))"
    ).format(n=PLACED)
    placed = scored.withColumn("_runs", F.expr(f"CASE WHEN size(_scored) = 0 THEN NULL ELSE transform(sequence(0, (size(_scored) - 1) div {PLACED}), b -> {run}) END"))
    placed = placed.withColumn("_bases", F.expr("aggregate(_runs, array(0L), (a, r) -> array_append(a, element_at(a, -1) + r.at))"))
    placed = placed.withColumn("_ends", F.expr(
        "coalesce(flatten(transform(_runs, (r, i) -> transform(r.all, x -> named_struct('start', x.start + _bases[i], 'end', x.end + _bases[i], 'score', x.score)))),"
        " cast(array() as array<struct<start:bigint,end:bigint,score:double>>))"
    ))
    redacted = F.expr(
        f"CASE WHEN exists(_scored, x -> x.score >= {threshold}) THEN concat(array_join(transform(_scored, x -> concat(element_at(_between, x.at + 1),"
        f" CASE WHEN x.score >= {threshold} THEN '{REDACTED}' ELSE x.hit END)), ''), element_at(_between, -1)) ELSE text END"
    )
    out = placed.withColumns({"findings": F.expr(f"filter(_ends, x -> x.score >= {threshold})"), "redacted": redacted, "n_candidates": F.size("_hits").cast("long")})
    return out.drop("_hits", "_between", "_described", "_scored", "_runs", "_bases", "_ends")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (start:end, joined), redacted_sha256."""
    spark = docs.sparkSession
    found = scan_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_forest(labelled_findings(spark)))
    places = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), places.alias("secrets"), F.sha2(F.encode(F.coalesce("redacted", F.lit("")), "UTF-8"), 256).alias("redacted_sha256"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced in its text; no row goes.  The other
    columns travel as one struct, so no name of theirs can clash."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = scan_documents(row, fit_forest(labelled_findings(docs.sparkSession)))
    return found.select(*[F.col("redacted").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
