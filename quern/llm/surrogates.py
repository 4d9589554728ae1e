"""PII surrogates, in DataFrame functions only.

Entities (mail addresses, phone numbers, IP addresses, card numbers, social security numbers, names
after a title) are found by pattern and cut into atoms: local part and domain, the digits after a
country code, the words of a name. Each distinct atom of the corpus gets one replacement of its
type, script and format, drawn by a keyed hash; of a name's word, the whole corpus says whether it is a
given or a family name and which gender its titles tell. A check of the whole corpus draws again where
two atoms got the same replacement, or one got what is a real atom, until all differ. So different
entities stay different, and an entity is replaced alike wherever it stands, however it is written,
with any title; after a title has told a name, its words are replaced in that document without one too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import documents, materialize, small, spread_join, text_id

#: Key of the query on test data. Real data need one of their own, in this setting of the session.
KEY_SETTING, TEST_KEY = "spark.quern.surrogates.key", "for test data only"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Each pattern starts only where a run starts (possessive or fenced), so that time is linear in the text.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+(?:\d[ .-]?|\(\d{1,4}\)[ .-]?){7,14}(?<=\d)(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])(?:1-)?\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))"
CARD = r"(?<![\d-])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4})(?![\d-])"
WOMEN = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Госпожа|Κυρία|السيدة|גברת|श्रीमती"
MEN = "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|Κύριος|السيد|אדון|श्री"
EITHER = "Dr|Prof"
# a name starts with a capital, in scripts that have some
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{WOMEN}|{MEN}|{EITHER})\.? (?:[\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'’-]*[\p{{L}}\p{{M}}])(?: [\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}'’-]*[\p{{L}}\p{{M}}]){{0,2}}"
ENTITY = "|".join((EMAIL, IP, SSN, PHONE, CARD, NAME))
KINDS = ("email", "ip", "ssn", "phone", "card", "name")

#: Name parts by script: two or more, closed by the ending of a woman's, a man's or a family's name.
PARTS = {
    "latin": ("ba,bel,bor,cal,cor,dan,del,dor,fal,fen,gar,gil,hal,hol,jor,kel,kor,lan,lev,lor,mar,mel,mor,nar,nel,nor,pal,per,ral,ren,rol,sal,sel,sor,tal,tem,tor,val,ver,wil", "ia,ella,ina", "en,or,us", "son,ley,ard,mont,well,ford"),
    "cyrillic": ("ба,бел,бор,вар,вел,вол,гал,гор,дан,дем,дор,жар,зар,кал,кор,лад,лев,лом,мар,мел,мир,нар,нов,пав,пер,рад,род,сав,сел,сол,тар,тим,тор,фед,хар,чер", "ина,ия,ана", "ин,ей,ан", "енко,ский,ук,ец"),
    "greek": ("αλ,αν,βα,γε,δα,δη,ελ,ζα,θε,ιω,κα,κο,λα,λε,μα,με,νι,πα,πε,ρο,σα,στε,τα,φι,χα", "ία,ινα,ουλα", "ος,ης,ας", "ιδης,ακης,όπουλος"),
    "arabic": ("با,سل,مر,نو,رش,فر,حم,جم,كر,لط,عب,زي,طا,شا,وس", "ية,اء", "يد,ير,ان", "اوي,اني,يري"),
    "hebrew": ("בר,גל,דן,טל,ליא,מור,נוע,עמ,רות,שיר,תמ,אור,חן", "ית,ה", "ון,אל", "סקי,מן,ני"),
    "devanagari": ("रा,सु,वि,अन,मो,दे,प्र,कि,ला,ना", "िता,िका", "ेश,ान", "वाल,कर,राज"),
}
#: Letters by script. A letter of a script that is not here is replaced by a Latin one.
LETTERS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "अआइईउऊएकखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
    "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "Thai": "กขคงจฉชซญดตถทธนบปผฝพฟมยรลวศษสหอ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ",
    "Han": "安白北春大德东方丰光国海和华家江金林明南平青山石天文西新永玉",
}


def sql_list(text: str) -> str:
    return "array(" + ",".join(f"'{x}'" for x in text.split(",")) + ")"


def kind_of(e: str) -> str:
    return (
        f"CASE WHEN instr({e}, '@') > 0 THEN 'email' WHEN {e} RLIKE r'^\\d+\\.\\d+\\.\\d+\\.\\d+$' THEN 'ip' "
        f"WHEN {e} RLIKE r'^\\d{{3}}-\\d{{2}}-\\d{{4}}$' THEN 'ssn' WHEN {e} RLIKE r'^[+(]|^(1-)?\\d{{3}}[-.]\\d{{3}}[-.]\\d{{4}}$' THEN 'phone' "
        f"WHEN {e} RLIKE r'^\\d' THEN 'card' ELSE 'name' END"
    )


def digits(e: str) -> str:
    return f"regexp_replace({e}, r'[^0-9]', '')"


def country(e: str) -> str:
    """Digits after a plus sign, up to what is no digit, or a 1 before a dash: they stay. (A run of more than
    3 digits has no code.)"""
    return f"regexp_extract({e}, r'^(?:\\+(?=\\d{{1,3}}(?!\\d))|(?=1-))(\\d{{1,3}})', 1)"


def script(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} RLIKE r'\\p{{Is{x.capitalize()}}}' THEN '{x}'" for x in PARTS if x != "latin") + " ELSE 'latin' END"


def gender(e: str) -> str:
    return f"CASE WHEN {e} RLIKE r'^(?:{WOMEN})[. ]' THEN 'f' WHEN {e} RLIKE r'^(?:{MEN})[. ]' THEN 'm' ELSE 'u' END"


def luhn(d: str) -> str:
    """Luhn sum of a string of digits."""
    return (
        f"aggregate(sequence(1, length({d})), 0L, (a, i) -> a + "
        f"CASE WHEN i % 2 = 1 THEN bigint(substring({d}, length({d}) + 1 - i, 1)) "
        f"ELSE (2 * int(substring({d}, length({d}) + 1 - i, 1))) div 10 + (2 * int(substring({d}, length({d}) + 1 - i, 1))) % 10 END)"
    )


def card_type(d: str) -> str:
    return f"concat('card:', left({d}, 1), ':', length({d}), if({luhn(d)} % 10 = 0, ':luhn', ''))"


def atoms(e: str) -> str:
    """Array of (type, value, role) of an entity. Case and punctuation are no part of the value, and the
    role (family, or given and gender) is none of a word of a name: it is known by the word alone."""
    one = lambda t, v: f"array(named_struct('t', {t}, 'v', {v}, 'r', ''))"
    words = f"slice(split({e}, ' '), 2, 3)"
    name = (
        f"transform({words}, (w, i) -> named_struct('t', concat('name:', {script('w')}), 'v', lower(w), "
        f"'r', if(i = size(split({e}, ' ')) - 2, 'family', concat('given:', {gender(e)}))))"
    )
    local, domain = f"lower(substring_index({e}, '@', 1))", f"lower(substring_index({e}, '@', -1))"
    number = f"substring({digits(e)}, length({country(e)}) + 1)"
    return (
        f"CASE {kind_of(e)} WHEN 'email' THEN concat({one(repr('local'), local)}, {one(repr('domain'), domain)}) "
        f"WHEN 'ip' THEN {one(repr('ip'), e)} WHEN 'ssn' THEN {one(repr('ssn'), digits(e))} "
        f"WHEN 'phone' THEN {one(f'concat({chr(39)}phone:{chr(39)}, {country(e)})', number)} "
        f"WHEN 'card' THEN {one(card_type(digits(e)), digits(e))} ELSE {name} END"
    )


def drawn(salt: str, n: str) -> str:
    return f"int(pmod(xxhash64(h, {salt}), {n}))"


def patterned(v: str, salt: str) -> str:
    """Letter for letter of its script, digit for digit; all else stays."""
    by = [f"WHEN c RLIKE r'\\p{{Is{x}}}' THEN substring('{own}', {drawn(f'{salt}, i', str(len(own)))} + 1, 1) " for x, own in LETTERS.items()]
    return (
        f"array_join(transform(split({v}, ''), (c, i) -> CASE WHEN c RLIKE '[a-z]' THEN substring('abcdefghijklmnopqrstuvwxyz', {drawn(f'{salt}, i', '26')} + 1, 1) "
        f"WHEN c RLIKE '[0-9]' THEN string({drawn(f'{salt}, i', '10')}) WHEN ascii(c) < 128 THEN c {''.join(by)}"
        f"WHEN c RLIKE r'\\p{{L}}|\\p{{N}}' THEN substring('abcdefghijklmnopqrstuvwxyz', {drawn(f'{salt}, i', '26')} + 1, 1) ELSE c END), '')"
    )


def replacement() -> str:
    """From columns t, v, r, h (keyed hash of type, value and attempt) and attempt. Where a format has few values and
    attempts run on, what is drawn gets longer; digits of fixed length never run out in practice."""
    longer = f"if(attempt > 3, string({drawn('0', '1000000')}), '')"
    label = "substring_index(v, '.', size(split(v, r'[.]')) - 1)"
    domain = f"concat({patterned(label, '1')}, {longer}, '.', substring_index(v, '.', -1))"
    ip = f"concat_ws('.', {drawn('1', '223')} + 1, {drawn('2', '256')}, {drawn('3', '256')}, {drawn('4', '254')} + 1)"
    card = f"concat(left(v, 1), substring({patterned('v', '1')}, 2, length(v) - 2))"
    check = f"concat({card}, if(t LIKE '%:luhn', string((10 - {luhn(f'concat({card}, {chr(39)}0{chr(39)})')} % 10) % 10), string({drawn('9', '10')})))"
    names = []
    for s, (parts, women, men, family) in PARTS.items():
        a, n = sql_list(parts), len(parts.split(","))
        stem = f"concat(get({a}, {drawn('1', str(n))}), get({a}, {drawn('2', str(n))}), if(attempt > 1, get({a}, {drawn('3', str(n))}), ''), if(attempt > 4, get({a}, {drawn('4', str(n))}), ''))"
        ends = "CASE r " + " ".join(f"WHEN '{r}' THEN {sql_list(x)}" for r, x in (("family", family), ("given:f", women), ("given:m", men))) + f" ELSE {sql_list(f'{women},{men}')} END"
        names.append(f"WHEN t = 'name:{s}' THEN concat({stem}, get({ends}, {drawn('5', f'size({ends})')}))")
    return (
        f"CASE WHEN t = 'local' THEN concat({patterned('v', '1')}, {longer}) WHEN t = 'domain' THEN {domain} WHEN t = 'ip' THEN {ip} "
        f"WHEN t LIKE 'card:%' THEN {check} {' '.join(names)} ELSE {patterned('v', '1')} END"
    )


def refill(e: str, d: str) -> str:
    """e with its digits put to those of d, one after another."""
    return f"array_join(transform(split({e}, ''), (c, i) -> if(c RLIKE '[0-9]', substring({d}, length({digits(f'substring({e}, 1, i + 1)')}), 1), c)), '')"


def cased(w: str, s: str) -> str:
    """s in the case of w."""
    return f"CASE WHEN {w} = upper({w}) AND {w} <> lower({w}) AND length({w}) > 1 THEN upper({s}) WHEN left({w}, 1) = upper(left({w}, 1)) THEN concat(upper(left({s}, 1)), substring({s}, 2)) ELSE {s} END"


def rendered(e: str, m: str) -> str:
    """The entity with its atoms replaced, in its own format. m: map from 'type|value'."""
    get = f"transform({atoms(e)}, z -> element_at({m}, concat(z.t, '|', z.v)))"
    words = f"zip_with(slice(split({e}, ' '), 2, 3), {get}, (w, s) -> {cased('w', 's')})"
    email = f"if({e} = upper({e}) AND {e} <> lower({e}), upper(array_join({get}, '@')), array_join({get}, '@'))"
    return (
        f"CASE {kind_of(e)} WHEN 'email' THEN {email} WHEN 'ip' THEN element_at({get}, 1) "
        f"WHEN 'phone' THEN {refill(e, f'concat({country(e)}, element_at({get}, 1))')} "
        f"WHEN 'name' THEN concat(element_at(split({e}, ' '), 1), ' ', array_join({words}, ' ')) ELSE {refill(e, f'element_at({get}, 1)')} END"
    )


def mentioned(x: str, m: str) -> str:
    """Text x with the words that column `said` tells (a pattern) replaced. m: as of `rendered`."""
    word = f"coalesce(element_at({m}, concat('name:', {script('w')}, '|', lower(w))), w)"
    return f"array_join(zip_with(split({x}, said, -1), transform(regexp_extract_all({x}, said, 0), w -> {cased('w', word)}), (a, b) -> concat(a, coalesce(b, ''))), '')"


def assign(found: DataFrame, secret: str, most_rounds: int = 40) -> DataFrame:
    """t, v, s, n for each distinct atom (t, v) of found (t, v, r): replacements that differ within a
    type and are no real atom of it; n: rows of the atom. Each round draws again for those that clash; all tables stay
    distributed. Where a format has hardly a value that isn't taken, those still left after most_rounds
    get each other's values: they still differ.
    """
    share = [F.count_if(F.col("r") == r).alias(c) for c, r in (("_fam", "family"), ("_f", "given:f"), ("_m", "given:m"), ("_u", "given:u"))]
    real = found.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"), *share)
    role = "CASE WHEN _fam + _f + _m + _u = 0 THEN '' WHEN _fam > _f + _m + _u THEN 'family' WHEN _f > _m THEN 'given:f' WHEN _m > _f THEN 'given:m' ELSE 'given:u' END"
    real = materialize(real.select("t", "v", "n", F.expr(role).alias("r")), "atoms")
    state = real.withColumn("attempt", F.lit(0))
    for turn in range(most_rounds + 1):
        h = F.sha2(F.concat_ws("|", F.lit(secret), "t", "v", F.col("attempt").cast("string")), 256)
        now = materialize(state.withColumn("h", h).withColumn("s", F.expr(replacement())).select("t", "v", "n", "r", "attempt", "s"), "drawn")
        first = now.groupBy("t", "s").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("k"))
        taken = first.join(real.select(F.col("t").alias("rt"), F.col("v").alias("rv")), F.expr("t = rt AND s = rv"), "left")
        bad = taken.where("k > 1 OR rv IS NOT NULL").select(F.col("t").alias("bt"), F.col("s").alias("bs"), F.when(F.col("rv").isNull(), F.col("first")).alias("stays"))
        bad = materialize(bad, "clashes")
        if bad.isEmpty():
            return now.select("t", "v", "s", "n")
        again = F.expr("bt IS NOT NULL AND (stays IS NULL OR v <> stays)")
        marked = now.join(small(bad), F.expr("t = bt AND s = bs"), "left").withColumn("again", again)
        if turn < most_rounds:
            state = marked.select("t", "v", "n", "r", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    # one that is alone trades with the first of its type that is settled
    marked = materialize(marked.select("t", "v", "s", "n", "again"), "settled")
    alone = marked.where("again").groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("t")
    also = marked.where("NOT again").join(small(alone), "t").groupBy("t").agg(F.min("v").alias("v")).withColumn("more", F.lit(True))
    marked = marked.join(small(also), ["t", "v"], "left").withColumn("again", F.col("again") | F.coalesce("more", F.lit(False)))
    line = Window.partitionBy("t").orderBy("v")
    left = marked.where("again")
    left = left.withColumn("s", F.coalesce(F.lead("v").over(line), F.min("v").over(Window.partitionBy("t"))))
    return marked.where("NOT again").select("t", "v", "s", "n").unionByName(left.select("t", "v", "s", "n"))


def replace_pii(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_ssn, n_phone, n_card, n_name, text with entities replaced, one row a row of df.

    A null text stays null and has no entities. Rows that are equal in key and text get equal
    results; a null key is a key like others. Other columns of df aren't read. An empty table gives no
    rows. n_name counts names after titles; the words of such a name are replaced in the same document
    without a title too, where they start with a capital or stand in capitals. Not found: names that no title
    tells in their document, names in scripts without spaces, numbers grouped 3-3-4 by spaces alone.
    """
    d = df.select(F.col(key).alias(key), text_id(text).alias("text_id"), F.col(text).alias("text"))
    # one search a text: entities get marks, by which the text is split; each second part is an entity
    mark, entity = "\u0001", F.lit(ENTITY)
    marked = F.split(F.regexp_replace("text", entity, F.lit(f"{mark}$0{mark}")), mark, -1)
    twice = F.flatten(F.zip_with(F.split("text", ENTITY, -1), F.regexp_extract_all("text", entity, F.lit(0)), lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    parts = F.when(F.instr("text", mark) > 0, twice).otherwise(marked)
    found = materialize(d.select(key, "text_id", parts.alias("parts")), "parts")
    told = found.where("size(parts) > 1").withColumn("entities", F.expr("filter(parts, (x, i) -> i % 2 = 1)"))
    each = told.select(key, "text_id", F.explode(F.array_distinct("entities")).alias("e"))
    each = materialize(each.select(key, "text_id", F.explode(F.expr(atoms("e"))).alias("a")).select(key, "text_id", "a.t", "a.v", "a.r").distinct(), "entities")
    # an atom may stand in a third of all documents
    own = spread_join(each.select(key, "text_id", "t", "v"), assign(each, secret), ["t", "v"], "n", each.count())
    own = own.groupBy(key, "text_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "t", "v"), "s"))).alias("given"))
    own = materialize(own, "given").withColumnRenamed(key, "_key").withColumnRenamed("text_id", "_text_id")
    out = told.join(small(own), F.expr(f"`{key}` <=> _key AND text_id = _text_id"))
    out = out.withColumn("kinds", F.expr(f"transform(entities, e -> {kind_of('e')})"))
    words = F.expr("flatten(transform(filter(entities, (e, i) -> kinds[i] = 'name'), e -> slice(split(e, ' '), 2, 3)))")
    out = out.withColumn("words", F.array_distinct(words)).withColumn("words", F.expr("array_distinct(flatten(transform(words, w -> array(w, upper(w), initcap(w)))))"))
    out = out.withColumn("said", F.when(F.size("words") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{N}])"))))
    fresh = F.expr(f"array_join(transform(parts, (x, i) -> CASE WHEN i % 2 = 1 THEN {rendered('x', 'given')} WHEN said IS NULL THEN x ELSE {mentioned('x', 'given')} END), '')")
    counts = [F.expr(f"cast(size(filter(kinds, k -> k = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    clean = found.where("parts IS NULL OR size(parts) = 1").select(key, *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], F.expr("parts[0]").alias("text"))
    return out.select(key, *counts, fresh.alias("text")).unionByName(clean)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir), spark.conf.get(KEY_SETTING, TEST_KEY))
