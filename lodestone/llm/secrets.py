"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL functions only.

Candidates, each with what stands before and after: values that are assigned to a name of a credential (four characters or
more, whatever they are made of), private key blocks as a whole, and any run of at least 16 of ``A-Za-z0-9+/_=.~-`` (so a
dotted token is one). One replacement marks all of a text, a split takes it apart.

Features: length, character classes and transitions between them, different characters, syllables, dictionary coverage,
signs of a path or an address, and neighbouring words (names of credentials, names of digests and identifiers, an
assignment, quotes).

The forest is trained by Spark's own implementation from labelled findings (a table before, candidate, after, label; by
default ``labelled()``, ``ROWS`` findings made by fixed rules from a running number, ever the same) and scores as an SQL
expression: the share of its trees that vote for a secret. The training table is bounded and apart from the corpus. Half of
its words stand in none of the feature's lists, so that the forest meets unknown words; ``labelled(start=...)`` with other
numbers is the held-out set of the tests.

Edge cases: null, empty and candidate-free texts give no row; equal rows give equal findings, a candidate that stands twice
gives two; texts of any length; marks U+0001 and U+0002 in a text count as spaces; a forest cannot be trained on one label
alone (an error says so). An empty table gives no findings. Output holds digests and the first four characters, never the
secret. Other columns of the table are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut

ROWS, TREES, DEPTH, SEED, THRESHOLD = 4000, 24, 6, 7, 0.5
#: Words that identifiers are made of; names before a credential; names before a digest or identifier.
DICTIONARY = (
    "access", "account", "admin", "article", "blog", "build", "change", "client", "config", "data", "date", "default", "demo", "doc", "download", "environ", "example",
    "file", "here", "image", "index", "insert", "item", "list", "local", "main", "model", "name", "news", "number", "order", "page", "password", "path", "place", "post",
    "report", "result", "sample", "secret", "section", "server", "service", "session", "source", "story", "table", "test", "text", "title", "token", "user", "value",
    "version", "view", "web", "your",
)
CREDENTIALS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "access-key", "private_key", "private key", "auth", "bearer", "credential")
DIGESTS = ("commit", "sha1", "sha256", "sha-256", "md5", "checksum", "digest", "hash", "uuid", "guid", "build", "etag", "revision", "version", "identifier", "fingerprint")

ASSIGNED = rf"""((?i:{"|".join(CREDENTIALS)})[A-Za-z0-9_]{{0,16}}["']?[ \t]{{0,3}}(?:=>|:=|[:=])[ \t]{{0,3}}["']?)([^\s"'`,;<>]{{4,512}}+)"""
BLOCK = r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?)"
RUN = r"([A-Za-z0-9][A-Za-z0-9+/_=.~-]{14,}+)"


def features(before: Column, candidate: Column, after: Column) -> dict[str, Column]:
    n, low, prior = F.length(candidate).cast("double"), F.lower(candidate), F.lower(F.right(before, F.lit(40)))
    count = lambda p: F.regexp_count(candidate, F.lit(p)).cast("double")
    kinds = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")
    turns = "|".join(f"(?<={a})(?={b})" for a in kinds for b in kinds if a != b)
    yes = lambda c: c.cast("double")
    return {
        "length": F.least(n, F.lit(200.0)),
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "marks": count("[^A-Za-z0-9]") / n,
        "transitions": count(turns) / n,
        "different": F.size(F.array_distinct(F.split(F.left(candidate, F.lit(64)), ""))) / F.least(n, F.lit(64.0)),
        "syllables": F.regexp_count(low, F.lit("[bcdfghjklmnpqrstvwxyz][aeiou]")).cast("double") / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")).cast("double") / n,
        "hexadecimal": yes(low.rlike(r"^[0-9a-f]{8,}\z")),
        "slashes": count("/"),
        "dots": count(r"\."),
        "dashes": count("[-_]"),
        "call": yes(candidate.rlike(r"[(\[{$]|^(?:None|null|true|false|undefined)\z")),
        "in_path": yes(prior.rlike(r"[/.\\]\z") | after.rlike(r"^[/.\\][A-Za-z0-9]")),
        "in_address": yes(prior.rlike(r"@\z") | after.rlike("^@")),
        "credential": yes(prior.rlike("|".join(CREDENTIALS))),
        "digest": yes(prior.rlike("|".join(DIGESTS))),
        "assigned": yes(prior.rlike(r"""(?:[=:]|=>)\s{0,3}["']?\z""")),
        "quoted": yes(prior.rlike(r"""["']\z""") & after.rlike(r"""^["']""")),
        "block": yes(candidate.startswith("-----BEGIN")),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, before, candidate, after), one row each."""
    marked = F.regexp_replace(F.translate("text", "\x01\x02", "  "), f"{ASSIGNED}|{BLOCK}|{RUN}", "$1\x01$2$3$4\x02")
    parts = docs.select("doc_id", F.split(marked, "\x01").alias("p"))
    one = lambda i: F.struct(
        F.right(F.get("p", i - 1), F.lit(60)).alias("before"), F.substring_index(F.get("p", i), "\x02", 1).alias("candidate"),
        F.left(F.substring_index(F.get("p", i), "\x02", -1), F.lit(40)).alias("after"), i.alias("ordinal"),
    )
    numbers = F.slice(F.sequence(F.lit(0), F.size("p")), 2, F.size("p") - 1)  # 1 to the number of marks
    rows = parts.select("doc_id", F.explode(F.transform(numbers, one)).alias("c"))
    return rows.select("doc_id", "c.ordinal", F.regexp_replace("c.before", "\x02", "").alias("before"), F.rtrim("c.candidate", F.lit(".")).alias("candidate"), "c.after").where(F.length("candidate") >= 4)


def labelled(spark: SparkSession, rows: int = ROWS, start: int = 0) -> DataFrame:
    """Findings with labels, from the numbers start to start + rows: credentials in code, settings and prose, against
    digests, identifiers, numbers of cards and phones, addresses, paths, words, placeholders and expressions."""
    id = F.col("id")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    some = lambda low, high, salt: (low + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1))).cast("int")
    hexed = lambda n, salt=0: F.left(F.sha2(F.concat_ws("-", id, F.lit(salt)), 512), n if isinstance(n, Column) else F.lit(n))
    mixed = lambda n, salt=0: F.left(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("+", id, F.lit(salt)), 512))), "[+/=]", "k"), n if isinstance(n, Column) else F.lit(n))
    digits = lambda n, salt: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "7")
    uuid = F.regexp_replace(hexed(32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    # words that the feature's lists lack: syllables in a row, from the number
    syllable = lambda salt: pick(("ba", "co", "du", "el", "fi", "gra", "hin", "ja", "ke", "lo", "mer", "nu", "or", "pri", "sta", "ten", "ul", "ver", "win", "za"), salt)
    made = lambda salt: F.concat(*[syllable(salt + k) for k in range(3)])
    known = lambda salt: pick(DICTIONARY, salt)
    word = lambda salt: F.when(F.pmod(F.xxhash64("id", F.lit(salt + 50)), F.lit(2)) == 0, known(salt)).otherwise(made(salt))
    name = F.concat(F.when(id % 4 == 0, F.concat(made(100), F.lit("_"))).otherwise(""), pick(CREDENTIALS, 3))
    name = F.when(id % 5 == 0, F.upper(name)).otherwise(name)
    digest = F.when(id % 3 == 0, made(110)).otherwise(pick(DIGESTS, 4))
    prose = F.concat(made(120), F.lit(" "), pick(("we set", "and then the", "in it was", "use of", "der", "la", "with"), 5))
    assign = pick((' = "', ': "', "='", "=", ": ", ' => "', "\": \"", " = "), 6)
    close = F.when(assign.contains('"'), '"').when(assign.contains("'"), "'").otherwise(" ")
    case = lambda x: F.when(id % 7 == 0, F.upper(x)).otherwise(x)
    token = F.when(id % 4 == 0, case(hexed(F.element_at(F.array(*map(F.lit, (24, 32, 40, 64))), some(1, 4, 8))))).when(id % 4 == 1, mixed(some(16, 48, 9)))
    token = token.when(id % 4 == 2, F.concat(pick(("ghp_", "sk-", "AKIA", "xoxb-", "glpat-", "AIza"), 7), mixed(some(16, 36, 10)))).otherwise(F.concat(F.lit("eyJ"), mixed(some(15, 33, 11), 1), F.lit("."), F.lit("eyJ"), mixed(some(20, 60, 12), 2), F.lit("."), mixed(43, 3)))
    passphrase = F.concat(mixed(some(3, 6, 13), 4), pick(("!", "#", "$", "%", "*", "@", "-"), 14), made(130), digits(2, 15))
    phrase = F.when(id % 2 == 0, passphrase).otherwise(F.concat(F.initcap(made(131)), pick(("!", "?", "&", "+"), 16), digits(3, 17)))
    block = F.concat(F.lit("-----BEGIN "), pick(("RSA ", "EC ", ""), 18), F.lit("PRIVATE KEY-----\n"), mixed(64, 5), F.lit("\n"), mixed(64, 6), F.lit("\n-----END PRIVATE KEY-----"))
    slug = F.concat(word(140), F.lit("-"), word(144), F.lit("-"), digits(3, 19), F.lit("-"), word(148))
    holder = F.when(id % 3 == 0, F.concat(pick(("your-", "example-", "sample_", "test-", "insert_", "my-"), 20), word(152), F.lit("-here"))).when(id % 3 == 1, F.concat(word(152), F.lit("-"), word(156), F.lit("-0123456789"))).otherwise(pick(("changeme", "password", "xxxxxxxxxxxx", "************", "${TOKEN}", "placeholder", "0000000000"), 21))
    call = F.when(id % 3 == 0, F.concat(F.lit("os.environ["), F.upper(made(160)))).when(id % 3 == 1, F.concat(F.lit("get_"), word(164), F.lit("(config)"))).otherwise(pick(("None", "null", "true", "undefined", "request.user", "self.token", "required"), 22))
    number = F.when(id % 3 == 0, digits(16, 23)).when(id % 3 == 1, F.concat(digits(3, 24), F.lit("-"), digits(4, 25), F.lit("-"), digits(4, 26), F.lit("-"), digits(5, 27))).otherwise(F.concat_ws(".", digits(3, 28), digits(3, 29), digits(3, 30), digits(3, 31), digits(2, 32)))
    host = F.concat(made(170), F.lit("."), word(174), F.lit(".example."), pick(("com", "org", "net"), 33))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cases = (
        (1, text(prose, " ", name, assign), token, text(close, " of it")),
        (1, text(prose, " ", name, assign), token, text(close, "\n")),
        (1, text(name, assign), phrase, text(close, " ", made(180))),
        (1, text("authorization: bearer "), token, text(" ", made(184))),
        (1, text("export ", name, "="), token, text("\n")),
        (1, text(prose, "\n"), block, text("\n")),
        (1, text("https://", made(188), ":"), token, text("@", host)),
        (1, text(prose, " the ", name, " is "), token, text(". ", made(192))),
        (0, text(prose, " ", digest, pick((": ", " ", "=", ' = "'), 34)), hexed(F.element_at(F.array(*map(F.lit, (24, 32, 40, 64))), some(1, 4, 35))), text(" and")),
        (0, text("see https://", word(196), ".example.com/", word(200), "/"), F.when(id % 2 == 0, hexed(40)).otherwise(slug), text(pick((".html", "/", "?x=1", " "), 36))),
        (0, text(prose, " ", pick(("id", "uuid", "ref", "key of"), 37), " "), uuid, text(" ", made(204))),
        (0, text(prose, " "), slug, text(" for")),
        (0, text(name, assign), holder, text(close)),
        (0, text(name, assign), call, text(close, "\n")),
        (0, text(prose, " "), number, text(" ", made(208))),
        (0, text(prose, " ", made(212), ".", digits(2, 38), "@"), host, text(" ", made(216))),
        (0, text(prose, " "), text(made(220), made(224), made(228)), text(" ", made(232))),
        (0, text(prose, " /"), text(word(236), "/", word(240), "/", digits(2, 39), "/", word(244), "-2024"), text(".txt ")),
        (0, text(prose, " "), text(word(248), "_", word(252), "_", word(256)), text("() ", made(260))),
        (0, text("src=\"data:image/png;base64,"), mixed(80, 7), text('" alt')),
    )
    rows_of = F.array(*[F.struct(b.alias("before"), c.alias("candidate"), a.alias("after"), F.lit(y).alias("label")) for y, b, c, a in cases])
    return spark.range(start, start + rows).select(F.element_at(rows_of, (F.pmod(F.xxhash64("id", F.lit(99)), F.lit(len(cases))) + 1).cast("int")).alias("r")).select("r.*")


def tree_sql(lines: list[str], names: list[str]) -> str:
    """One tree of a printed forest as nested CASE expressions."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return f"{float(head.split(':')[1])}D"
    feature, at = re.fullmatch(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", head).groups()
    yes = tree_sql(lines, names)
    lines.pop(0)  # the Else of the same test
    return f"CASE WHEN {names[int(feature)]} <= {at}D THEN {yes} ELSE {tree_sql(lines, names)} END"


def grow(findings: DataFrame):
    """The features of labelled findings, their names, and Spark's forest over them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = features(F.col("before"), F.col("candidate"), F.col("after"))
    names = list(made)
    findings = cut(findings.select("before", "candidate", "after", "label"))  # the forest reads it many times
    rows = findings.where(F.col("label").isin(0, 1)).select(*[v.alias(k) for k, v in made.items()], F.col("label").cast("double").alias("label")).coalesce(2)
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled findings of both kinds are needed")
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(ready)
    return ready, names, forest


def train(findings: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the features, and an SQL expression (1 or 0) for each tree."""
    _, names, forest = grow(findings)
    trees = re.split(r"\n\s*Tree \d+ \(weight [0-9.]+\):\n", forest.toDebugString)[1:]
    return names, [tree_sql([x for x in t.split("\n") if x.strip()], names) for t in trees]


def judge(found: DataFrame, forest: tuple[list[str], list[str]]) -> DataFrame:
    """found (before, candidate, after, ...) with score and kept."""
    names, trees = forest
    made = features(F.col("before"), F.col("candidate"), F.col("after"))
    score = F.expr(" + ".join(f"({t})" for t in trees)) / len(trees)
    return found.withColumns(made).withColumn("score", F.round(score, 6)).withColumn("kept", F.col("score") >= THRESHOLD).drop(*names)


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, ordinal, candidate, before, after, score, kept) of every candidate of docs."""
    return judge(candidates(docs), train(labelled(docs.sparkSession) if findings is None else findings))


def digest(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "ordinal", F.length("candidate").cast("long").alias("n_chars"), F.concat(F.left("candidate", F.lit(4)), F.lit("...")).alias("hint"), F.sha2("candidate", 256).alias("finding_sha256"), "score", "kept")
