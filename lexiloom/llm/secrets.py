"""Secret scan: generous candidates, and a random forest that removes the false ones, all on the JVM.

Candidates are long runs of the characters of keys and tokens, once more without their leading signs, and the values of
assignments to names like token or password, of any length. Their features are length, character transitions, coverage by dictionary words, the path they
come from and the words beside them. The forest learns from labelled findings (label, value, before, after, path): by
default a fixed number made by expressions over spark.range, half of them secrets in the forms that services issue and
half the usual false alarms, such as identifiers, dates, checksums, numbers and placeholders.

Every candidate is returned with its score. Defined results: null and empty texts have no candidates; offsets count code
points; a span that both generators propose is one candidate; a null path is empty; repeated rows are searched one by
one; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

RUN = "[A-Za-z0-9+/_=-]{16,}+"
ASSIGNED = r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)"
AROUND = 40
FINDINGS, TREES, DEPTH, SEED = 6000, 24, 7, 11
#: A candidate is a secret from this probability on.
SECRET = 0.5
#: Words whose share of a candidate counts as dictionary coverage.
DICTIONARY = (
    "account admin application archive array background base batch body buffer build button cache change channel class client cluster code config content control copy count custom data date db "
    "default delete device document domain download driver edit element email error event example field file filter folder form format function gateway get global group handler header height home "
    "host html http https icon id image import index info input instance json key label layer layout length level library link list local login main manager master message metadata method mode "
    "model module name network new node number object option order org output package path policy pool port process product project property public query queue read record region release remote "
    "report request reset resource response result role root route row schema script search section server service session set setting source start state static status storage store stream string "
    "style sub system table target template test text title token tool total type unit update upload user util value version video view widget window worker"
).split()
ASSIGNING = r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer)"
PLACEHOLDER = r"(?i)(example|dummy|sample|placeholder|changeme|your[_-]|xxx|fake|test|todo|<|\$\{|123456|abcdef)"
CHECKSUM = r"(?i)(sha-?\d*|md5|checksum|hash|commit|revision|integrity|digest|etag|uuid|guid|isbn|build)"
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ|SG\.|npm_|hf_)"


#: Running sums are taken in blocks of so many matches, so that no long array is copied for each of its elements.
TOGETHER = 256


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(lengths: Column) -> Column:
    """For each element of an array of numbers the sum of those before it."""
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")

    def one(s: Column, n: Column) -> Column:
        return state(s["at"] + n, F.array_append(s["out"], s["at"]))

    def block(s: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(lengths, k * TOGETHER + 1, TOGETHER), state(s["at"], none("int")), one)
        return named(own, lambda o: state(o["at"], F.array_append(s["out"], o["out"])))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / TOGETHER).cast("int"))
    return F.flatten(F.aggregate(blocks, state(F.lit(0), none("array<int>")), block, lambda s: s["out"]))


SPAN = "struct<start:int,value:string,before:string,after:string>"
#: A match has ten characters or more, so so many of them with what lies between fill AROUND.
NEIGHBOURS = 4


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<SPAN> of the pattern's matches in text, with AROUND characters on either side; code points from 0.

    Matches and the pieces between them make up the text in turn, so starts are running sums of their lengths, and what
    is around a match is in the pieces and matches next to it: a text is never searched once for each match. A group, if
    one is asked for, must end its match.
    """

    def placed(found: Column, pieces: Column, ends: Column) -> Column:
        def at(match: Column, i: Column) -> Column:
            last = lambda part: F.coalesce(F.right(part, F.lit(AROUND)), F.lit(""))
            first = lambda part: F.coalesce(F.left(part, F.lit(AROUND)), F.lit(""))
            left = [last(part) for k in range(NEIGHBOURS, 0, -1) for part in (F.get(found, i - k), F.get(pieces, i - k + 1))]
            right = [first(part) for k in range(1, NEIGHBOURS + 1) for part in (F.get(pieces, i + k), F.get(found, i + k))]
            value = match if not group else F.regexp_extract(match, pattern, group)

            def span(v: Column) -> Column:
                lead = F.left(match, F.char_length(match) - F.char_length(v))
                return F.struct((F.get(ends, i + 1) - F.char_length(v)).cast("int").alias("start"), v.alias("value"), F.right(F.concat(*left, lead), F.lit(AROUND)).alias("before"), F.left(F.concat(*right), F.lit(AROUND)).alias("after"))

            return named(value, span)

        return F.transform(found, at)

    def of(found: Column, pieces: Column) -> Column:
        # one piece more than matches; the sum before the piece that follows a match is where the match ends
        lengths = F.transform(pieces, lambda piece, i: F.char_length(piece) + F.coalesce(F.char_length(F.get(found, i)), F.lit(0)))
        return named(lengths, lambda n: named(running_sums(n), lambda ends: placed(found, pieces, ends)))

    both = named(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: named(F.split(text, pattern), lambda pieces: of(found, pieces)))
    return F.when(text.rlike(pattern), both).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _without_signs(s: Column) -> Column:
    """A span without its leading signs, which may be its own or of what stands before it."""
    kept = F.regexp_replace(s["value"], "^[-=_/+]++", "")
    signs = F.char_length(s["value"]) - F.char_length(kept)
    return F.struct((s["start"] + signs).alias("start"), kept.alias("value"), F.right(F.concat(s["before"], F.left(s["value"], signs)), F.lit(AROUND)).alias("before"), s["after"].alias("after"))


def _is_run(s: Column) -> Column:
    """Whether an assigned value is a run as well, with or without the sign that assigns it: what parts values ends runs too."""
    return s["value"].rlike(f"^{RUN}$") & s["value"].rlike("[A-Za-z0-9]") & (s["before"].rlike(r"(?:^|[^A-Za-z0-9+/_=-])$") | (s["before"].rlike(r"[^A-Za-z0-9+/_=-]=$") & ~s["value"].rlike("^[-=_/+]")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, value, before, after and path of each candidate in docs (doc_id, text, source)."""
    text = F.col("__text")
    path = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text_of().alias("__text"), path.alias("path")).where(text.rlike(RUN) | text.rlike(ASSIGNED))
    runs = F.filter(spans(text, RUN), lambda s: s["value"].rlike("[A-Za-z0-9]"))  # a line of signs only is no key
    assigned = F.filter(spans(text, ASSIGNED, 1), lambda s: ~_is_run(s))
    bare = lambda found: F.transform(F.filter(found, lambda s: s["value"].rlike("^[-=_/+]")), _without_signs)
    one = named(runs, lambda found: F.concat(found, F.filter(bare(found), lambda s: s["value"].rlike(RUN)), assigned))
    some = rows.select("doc_id", "path", F.explode(one).alias("c"))
    return some.select("doc_id", F.col("c.start").alias("start"), (F.col("c.start") + F.char_length("c.value")).alias("end"), "c.value", "c.before", "c.after", "path")


def features(rows: DataFrame, dictionary: Sequence[str] = DICTIONARY) -> tuple[DataFrame, list[str]]:
    """rows (value, before, after, path) with a numeric column for each feature, and their names."""
    value, before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "before", "after", "path"))
    length = F.greatest(F.lit(1), F.char_length(value))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    words = "(?:" + "|".join(sorted((w for w in dictionary if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
    made = {
        "f_length": length,
        "f_class_changes": count("[a-z](?=[0-9A-Z])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9])") / length,
        "f_vowel_changes": count("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])") / length,
        "f_digits": count("[0-9]") / length,
        "f_upper": count("[A-Z]") / length,
        "f_signs": count("[^A-Za-z0-9]") / length,
        "f_hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "f_repeats": count(r"(.)\1") / length,
        "f_dictionary": 1 - F.char_length(F.regexp_replace(F.lower(value), words, "")) / length,
        "f_longest_letters": F.array_max(F.transform(F.split(value, "[^A-Za-z]"), F.char_length)),
        "f_issued": value.rlike(ISSUED).cast("int"),
        "f_date": value.rlike(r"(?:19|20)\d\d[-/_]?[01]\d[-/_]?[0-3]\d").cast("int"),
        "f_uuid": value.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("int"),
        "f_placeholder": (value.rlike(PLACEHOLDER) | before.rlike(PLACEHOLDER)).cast("int"),
        "f_assigned": before.rlike(ASSIGNING + r"\w*[\"']?\s*[:=]\s*[\"']?$").cast("int"),
        "f_near_name": before.rlike(ASSIGNING).cast("int"),
        "f_quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("int"),
        "f_checksum": before.rlike(CHECKSUM).cast("int"),
        "f_url": (before.rlike(r"(?i)(https?:|www\.|//|\.)\S*$")).cast("int"),
        "f_path_tests": path.rlike(r"(?i)(test|spec|example|fixture|mock|doc)").cast("int"),
    }
    return rows.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in made.items()]), list(made)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """label, value, before, after, path of n findings, made from the digests of their numbers."""
    i = F.col("id")
    pick = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), i), F.lit(k)).cast("int")
    of = lambda salt, values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), pick(salt, len(values)) + 1)
    hexes = F.sha2(F.concat(F.lit("h"), i.cast("string")), 256)
    base = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")), 512))), "=", "")
    alnum = F.regexp_replace(base, "[+/]", "x")
    words = lambda sign: F.concat_ws(sign, *[of(f"w{k}", DICTIONARY) for k in range(4)], (pick("num", 2000) + 1).cast("string"))
    digits = F.regexp_replace(F.concat(hexes, hexes), "[a-f]", "")
    secret = of("secret", [F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), hexes, F.upper(F.substring(hexes, 1, 40)), F.substring(base, 1, 40), F.substring(alnum, 1, 32), F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24))])
    date = F.date_format(F.timestamp_seconds(pick("ts", 1 << 30)), "yyyy-MM-dd'T'HH-mm-ss")
    uuid = F.concat_ws("-", *[F.substring(hexes, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    false = of("false", [words("_"), words("-"), words("/"), words(""), date, uuid, F.substring(digits, 1, 18), F.concat(F.repeat(F.lit("x"), 18), F.lit("1")), F.lit("1234567890abcdef1234"), F.substring(hexes, 1, 40), hexes])
    assigned = of("before", ['token = "', "API_KEY=", 'secret: "', "password = '", 'TOKEN = "', "auth_token: ", "aws_secret_access_key = ", "Bearer "])
    plain = of("before", ["the ", "see ", "in ", ". ", "id: ", "name = ", "const page = '", "https://host.example/"])
    summed = of("before", ["sha256:", "commit ", "md5 ", "integrity sha512-", "etag: ", "checksum = "])
    label = pick("label", 2)
    is_hex = false.rlike("^[0-9a-f]{40,}$")
    before = F.when(label == 1, F.when(pick("bare", 8) == 0, plain).otherwise(assigned)).when(is_hex, summed).when(pick("bare", 6) == 0, assigned).otherwise(plain)
    path = F.when((label == 0) & (pick("path", 4) == 0), of("paths", ["tests/fixtures", "docs/example", "spec/mock"])).otherwise(of("paths", ["src/app", "config", "src7"]))
    after = F.when(before.rlike("[\"']$"), F.substring(before, -1, 1)).otherwise(F.lit(" "))
    lead = of("lead", ["and the ", "then ", "", "value is in "])
    return spark.range(0, n, 1, 4).select(label.cast("double").alias("label"), F.when(label == 1, secret).otherwise(false).alias("value"), F.concat(lead, before).alias("before"), F.concat(after, F.lit(" and")).alias("after"), path.alias("path"))


def train(findings: DataFrame) -> tuple[RandomForestClassificationModel, VectorAssembler]:
    """A forest fitted on labelled findings."""
    rows, names = features(findings)
    assembler = VectorAssembler(inputCols=names, outputCol="__features")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(assembler.transform(rows).select("__features", "label")), assembler


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, value, score, is_secret of each candidate in docs (doc_id, text, source)."""
    model, assembler = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows, _ = features(candidates(docs))
    score = vector_to_array("__p")[1]
    return model.transform(assembler.transform(rows)).select("doc_id", "start", "end", "value", score.alias("score"), (score >= SECRET).alias("is_secret"))


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
