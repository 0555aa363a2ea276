"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values behind a credential word (``password=...``,
``client_secret_key = "..."``, ``Authorization: Bearer ...``), passwords in
URLs, PEM private keys, JSON web tokens and tokens with a known prefix. The
pattern is wide (values of any length, quoted ones of any character), and false
positives are the forest's to drop. It judges each by

* its length and its share of digits and of distinct characters;
* its character transitions: how often neighbours change class, and the mean
  log probability of its letter pairs under a model counted over the corpus;
* dictionary coverage: how much of it placeholder words make up, and how much
  words that the corpus uses often;
* its path (words of the path column such as ``test`` or ``example``) and whole
  words on both sides of it.

``learn`` counts every word of every text (one aggregation by word, then by
letter pair and by hash bucket), so the model's size is fixed however large the
corpus is; licence texts of this package are counted along, so a corpus without
words has a model too. The forest is trained with Spark's DataFrame learner from
labelled findings (by default ``labelled_findings``: at most ``TRAIN_ROWS`` rows
made by a fixed rule), a bounded sample in one partition, so that every run
grows the same trees. Model and trees are then written out as literals: a scan
is one projection of built-in functions over the texts, with no shuffle and no
Python.

Defined results: null and empty texts have no candidate; whole texts of any
length are read; every occurrence is a finding, also when repeated; a vote of
exactly one half is a secret; null ids and paths are kept (a null path has no
path words); an empty table gives an empty table; repeated rows give repeated
rows; input columns other than id, text and path are ignored by ``scan`` and
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.license_texts import TEMPLATES
from assayer.llm.words import let
from assayer.session import table

TRAIN_ROWS = 3000
TREES, DEPTH, SEED = 15, 6, 7
#: Whole words on each side of a candidate that count as its neighbours.
BESIDE = 8

_WORDS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization|auth|credentials?|bearer"
#: A key word, what ``_`` or ``-`` adds to it, and the sign behind it; or a scheme behind Authorization; or a URL's user.
_KEY = (
    rf"(?:(?<![a-z])authorization\\?['\"]?[ \t]{{0,3}}[:=][ \t]{{0,3}}\\?['\"]?(?:bearer|basic|token|digest)[ \t]{{1,3}}"
    rf"|(?<![a-z])(?:{_WORDS})(?:[_-][a-z0-9_-]*+)?\\?['\"]?[ \t]{{0,3}}(?::=|=>|==?|:|is)[ \t]{{0,3}}\\?['\"]?"
    r"|(?<![a-z])bearer[ \t]{1,3}['\"]?)"
)
#: A quoted value is all up to its quote; another one ends at white space, a quote or one of ``\,;<>&``, without
#: closing brackets and full stops. Possessive and without an upper bound: a value is whole, however long.
_VALUE = r"(?:(?<=\")[^\"\\\r\n]++(?=\\?\")|(?<=')[^'\\\r\n]++(?=\\?')|[^\s'\"\\,;<>&]*[^\s'\"\\,;<>&)\]}.])"
_URL = r"(?<=[a-z0-9+.-])://[^\s/:@'\"<>]*+:"
_PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: Key word and value, a URL's password, or a value with a known prefix or form.
CANDIDATE = (
    rf"(?i)(?:{_KEY}{_VALUE})"
    rf"|(?:{_URL}[^\s/'\"<>]+(?=@))"
    rf"|(?-i:{_PEM}(?:[\s\S]*?{_PEM.replace('BEGIN', 'END')}|[A-Za-z0-9+/=\s]*+))"
    r"|(?-i:(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+){0,3}+)"
    r"|(?-i:(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{12,}+(?![A-Za-z0-9]))"
    r"|(?-i:(?<![A-Za-z0-9])(?:ghp|gho|ghs|github_pat|glpat|xoxb|xoxp|sk|rk)[_-][A-Za-z0-9_-]{16,}+)"
)
_SPLIT = rf"(?i)^({_KEY}|://[^\s/:@'\"<>]*+:)"
#: Placeholder words of code and prose. Fixed values.
DICTIONARY = [
    "password", "secret", "token", "example", "your", "here", "test", "change", "replace", "insert", "sample", "dummy", "value",
    "string", "null", "none", "true", "false", "default", "user", "name", "placeholder", "xxxx", "1234", "abcd", "the", "and", "required",
]
PATH_WORDS = ["test", "example", "sample", "mock", "fixture", "doc", "spec"]
BESIDE_WORDS = ["example", "placeholder", "fake", "dummy", "sample", "your", "such as", "e.g", "checksum", "sha1", "sha256", "md5", "commit", "digest"]
FEATURES = ["length", "changes", "flow", "covered", "known", "digits", "distinct", "keyed", "prefixed", "path", "beside"]
#: Words are counted in so many buckets; a word is a known one if its bucket has so many times the mean.
WORD_BUCKETS, KNOWN_TIMES = 1 << 13, 4.0
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PREFIX = "^(AKIA|ASIA|gh[pos]_|github_pat_|glpat-|xox[bp]-|[sr]k[_-]|eyJ|-----BEGIN )"


@dataclass(frozen=True)
class TextModel:
    """Natural log probabilities of letter pairs (26 x 26, by row) and which word buckets are known."""

    pairs: tuple[float, ...]
    known: tuple[bool, ...]


def _base_words() -> Counter:
    return Counter(w for _, text in TEMPLATES for w in re.findall("[a-z]+", text.lower()))


def learn(docs: DataFrame, text_col: str = "text") -> TextModel:
    """The model of all words (runs of a-z after lower-casing) of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(docs[text_col]), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    base = docs.sparkSession.createDataFrame(sorted(_base_words().items()), "w string, n long")
    every = words.unionByName(base)
    letters = F.split("w", "")
    pairs = let(letters, lambda c: F.transform(F.slice(c, 2, F.size(c)), lambda x, i: F.concat(F.get(c, i), x)))
    parts = every.select("n", F.explode(F.concat(pairs, F.array(F.pmod(F.xxhash64("w"), F.lit(WORD_BUCKETS)).cast("string")))).alias("part"))
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator()}  # 676 pairs and the buckets
    flow = []
    for a in _LETTERS:
        row = [counts.get(a + b, 0) + 1 for b in _LETTERS]
        flow += [round(math.log(n / sum(row)), 6) for n in row]
    buckets = [counts.get(str(k), 0) for k in range(WORD_BUCKETS)]
    least = KNOWN_TIMES * sum(buckets) / WORD_BUCKETS
    return TextModel(tuple(flow), tuple(n >= least for n in buckets))


def features(model: TextModel, value: Column, key: Column, before: Column, after: Column, path: Column) -> Column:
    """Struct of ``FEATURES`` (doubles) of one candidate."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    lower = F.lower(value)
    any_of = lambda col, words: F.when(F.coalesce(F.lower(col), F.lit("")).rlike("|".join(w.replace(".", "[.]") for w in words)), 1.0).otherwise(0.0)
    pairs = F.split(F.lit(",".join(map(str, model.pairs))), ",").cast("array<double>")
    known = F.split(F.lit(",".join("1" if k else "0" for k in model.known)), ",").cast("array<int>")
    runs = F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0))
    code = lambda c: F.ascii(c) - 97
    step = lambda c: F.transform(F.slice(c, 2, F.size(c)), lambda x, i: F.get(pairs, code(F.get(c, i)) * 26 + code(x)))
    steps = F.flatten(F.transform(runs, lambda w: let(F.split(w, ""), step)))
    flow = let(steps, lambda x: F.when(F.size(x) > 0, F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x), 6)).otherwise(-6.0))
    used = F.aggregate(runs, F.lit(0), lambda s, w: s + F.length(w) * F.get(known, F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("int")))
    found = {
        "length": F.length(value).cast("double"),
        "changes": F.regexp_count(shape, F.lit("a(?=[^a])|A(?=[^A])|0(?=[^0])")) / n,
        "flow": flow,
        "covered": (n - F.length(F.regexp_replace(lower, "|".join(DICTIONARY), ""))) / n,
        "known": used / n,
        "digits": F.regexp_count(value, F.lit("[0-9]")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(24.0)),
        "keyed": F.when(key != "", 1.0).otherwise(0.0),
        "prefixed": F.when(value.rlike(_PREFIX), 1.0).otherwise(0.0),
        "path": any_of(path, PATH_WORDS),
        "beside": any_of(F.concat_ws(" ", before, after), BESIDE_WORDS),
    }
    return F.struct(*[found[f].alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """value, key, before, after, path, label: made-up findings, about half real credentials, half common false alarms.

    Values are composed without regard to the candidate pattern: credentials are
    random characters of several alphabets and of hashed lengths, false alarms
    are words, names, places in files, versions, dates and fingerprints.
    """
    i = F.col("id")
    number = lambda tag, n: F.pmod(F.xxhash64(i, F.lit(tag)), F.lit(n)).cast("int")
    pick = lambda tag, words: F.element_at(F.array(*map(F.lit, words)), number(tag, len(words)) + 1)
    hexed = lambda tag: F.concat(F.sha2(F.concat(i.cast("string"), F.lit(f":{tag}")), 256), F.sha2(F.concat(i.cast("string"), F.lit(f";{tag}")), 256))
    mixed = lambda tag: F.translate(F.to_char(F.unhex(hexed(tag)), F.lit("base64")), "+/=\n", "xyz")
    upper = F.translate(F.upper(hexed("u")), "0123456789ABCDEF", "Q7ZX2RWJ5KTYAMCP")
    cut = lambda text, low, span: F.substr(text, F.lit(1), low + number("length", span))
    vocabulary = sorted(w for w in _base_words() if len(w) >= 4)
    word = lambda tag: pick(f"word {tag}", vocabulary)
    title = lambda tag: F.initcap(word(tag))
    sign = pick("sign", ["@", "!", "#", "$", "%", "*", "&", "?"])
    fill = pick("fill", ["your_token_here", "changeme123", "example-password", "insert-secret-here", "xxxxxxxxxxxx", "REPLACE_ME_NOW", "password123", "none.required", "default-value", "placeholder", "<none>", "${TOKEN}", "null"])
    short = pick("short", ["required", "wrong", "not", "that", "changed", "kept", "known", "invalid", "a", "missing", "reset", "about", "stored", "here", "in", "is"])
    real = [
        cut(hexed(1), 12, 53), cut(hexed(2), 32, 33), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), cut(mixed(3), 20, 60), F.concat(F.lit("ghp_"), F.substring(mixed(4), 1, 36)),
        F.concat(F.substring(mixed(5), 1, 3), sign, F.substring(mixed(5), 5, 5)), F.concat(F.lit("eyJ"), F.substring(mixed(6), 1, 20), F.lit(".eyJ"), mixed(7), F.lit("."), mixed(8)),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed(9), F.lit("\n-----END RSA PRIVATE KEY-----")), F.concat(F.substring(mixed(10), 1, 5), sign, F.substring(mixed(10), 7, 6)), F.concat(F.lit("sk-"), cut(mixed(11), 20, 30)),
    ]
    false = [
        fill, word(1), cut(hexed(12), 32, 33), cut(hexed(13), 12, 53), F.concat(word(1), F.lit("-"), word(2)), short, F.concat(word(1), F.lit(" "), word(2)), F.concat(word(1), pick("join", [".", "_", "/", "::"]), word(2)),
        F.concat(title(1), title(2)), F.concat_ws(".", number("a", 9), number("b", 30), number("c", 12)), F.concat(F.lit("sk-"), word(1), F.lit("-"), word(2)), F.concat(F.lit("20"), number("y", 30) + 10, F.lit("-"), number("m", 9) + 1, F.lit("-"), number("d", 27) + 1),
    ]
    kind = F.pmod(i, F.lit(len(real) + len(false)))
    value = F.element_at(F.array(*real, *false), (kind + 1).cast("int"))
    plain = pick("key", ["password=", "token = \"", "secret: ", "api_key=", "password is ", "client_secret_key = ", "auth: ", "Bearer "])
    key = F.when(kind.isin(2, 4, 6, 7, 9, 20), F.lit("")).when(kind == 8, pick("url", ["://admin:", "://root:", "://app:"])).otherwise(plain)
    warned = (kind == 12) & (number("behind", 2) == 1)
    after = F.when(warned, pick("after", ["\" # example only", " (placeholder)", "\" # fake", " is a sample value"])).otherwise(F.concat(pick("end", ["", "\"", " and more", "\" # login", ", user"]), F.lit(" "), word(3)))
    before = F.when((kind == 12) & ~warned, pick("before", ["commit sha1 ", "an example ", "file checksum ", "a fake one, "])).otherwise(F.concat(word(4), F.lit(" "), word(5), F.lit(" ")))
    path = F.when(kind == 13, pick("path", ["tests/fixture.py", "docs/example.md", "spec/mock.rb"])).otherwise(pick("place", ["src0", "src/main.py", "src5", "config/app.yml", "web"]))
    label = (kind < len(real)).cast("double")
    return spark.range(0, rows, 1, 1).select(value.alias("value"), key.alias("key"), before.alias("before"), after.alias("after"), path.alias("path"), label.alias("label"))


@dataclass(frozen=True)
class Forest:
    """A text model and trees over ``FEATURES``: a tree is (feature, threshold, left, right), a leaf its prediction."""

    model: TextModel
    trees: tuple

    def vote(self, value: Column, key: Column, before: Column, after: Column, path: Column) -> Column:
        """Mean vote (0 to 1) of the trees on one candidate."""

        def column(node, row: Column) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(row[FEATURES[at]] <= threshold, column(left, row)).otherwise(column(right, row))

        def mean(row: Column) -> Column:
            total = column(self.trees[0], row)
            for tree in self.trees[1:]:
                total = total + column(tree, row)
            return F.round(total / len(self.trees), 6)

        return let(features(self.model, value, key, before, after, path), mean)


def train(findings: DataFrame, model: TextModel, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest grown on ``findings`` (value, key, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    row = features(model, *map(F.col, ("value", "key", "before", "after", "path")))
    bounded = findings.limit(rows).coalesce(1).select(row.alias("f"), "label").select("f.*", "label")
    learner = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", seed=SEED)
    forest = learner.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(bounded))

    def grown(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return int(split.featureIndex()), float(split.threshold()), grown(node.leftChild()), grown(node.rightChild())

    return Forest(model, tuple(grown(tree._call_java("rootNode")) for tree in forest.trees))


def default_forest(docs: DataFrame, text_col: str = "text") -> Forest:
    """The model of ``docs`` and a forest from ``labelled_findings``."""
    return train(labelled_findings(docs.sparkSession), learn(docs, text_col))


def _around(text: Column) -> Column:
    """found, before and after (up to ``BESIDE`` whole words on its line) of each match; texts are cut only where there is a match."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    between = F.split(text, CANDIDATE, -1)
    before = lambda part: F.substring_index(F.substring_index(part, "\n", -1), " ", -BESIDE - 1)
    after = lambda part: F.substring_index(F.substring_index(part, "\n", 1), " ", BESIDE + 1)
    each = let(between, lambda parts: F.transform(found, lambda f, i: F.struct(f.alias("found"), before(F.get(parts, i)).alias("before"), after(F.get(parts, i + 1)).alias("after"))))
    return F.when(text.rlike(CANDIDATE), each).otherwise(F.array().cast("array<struct<found:string,before:string,after:string>>"))


def _judged(text: Column, path: Column, forest: Forest) -> Column:
    """Array of (found, key, value, before, after, vote), one for each candidate of a text, in order."""
    key = lambda c: F.regexp_extract(c["found"], _SPLIT, 1)
    parted = F.transform(_around(text), lambda c: let(key(c), lambda k: F.struct(c["found"].alias("found"), k.alias("key"), F.substr(c["found"], F.length(k) + 1).alias("value"), c["before"].alias("before"), c["after"].alias("after"))))
    return F.transform(parted, lambda c: F.struct(*[c[f].alias(f) for f in ("found", "key", "value", "before", "after")], forest.vote(c["value"], c["key"], c["before"], c["after"], path).alias("vote")))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """id, no, found, key, value, before, after, path, vote and secret (vote of at least one half) of every candidate."""
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    every = docs.select(docs[id_col].alias("id"), path.alias("path"), F.posexplode(_judged(F.coalesce(docs[text_col], F.lit("")), path, forest)).alias("no", "c"))
    return every.select("id", "no", "c.found", "c.key", "c.value", "c.before", "c.after", "path", "c.vote", (F.col("c.vote") >= 0.5).alias("secret"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every value that the forest calls a secret replaced by ``mark``, wherever it stands in its text.

    The secrets of a text are an array beside it: one projection, so no row is joined, split off or shuffled.
    """
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    text = docs[text_col]

    def cleaned(found: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(found, lambda c: c["vote"] >= 0.5), lambda c: F.struct(F.length(c["value"]).alias("n"), c["value"].alias("v"))))
        return F.aggregate(F.sort_array(values, asc=False), text, lambda t, v: F.replace(t, v["v"], F.lit(mark)))  # longest first

    clean = F.when(text.rlike(CANDIDATE), let(_judged(text, path, forest), cleaned)).otherwise(text)
    return docs.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs, default_forest(docs))
    return found.select(F.col("id").alias("doc_id"), F.col("no").cast("long").alias("finding_no"), "key", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), "vote", "secret")


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
