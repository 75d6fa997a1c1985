"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, langid, licenses, media, minhash, negatives, packing, quality, sampling, simhash, spelling, suffix_dedup, token_store, warc


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, decoded_crc32 (of what the ids decode to), n_pieces."""
    return sampling.encode(common.documents(spark, sf_dir), digest=True).withColumn("n_pieces", F.coalesce(F.size("piece_ids"), F.lit(0)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold("doc_id") == 1
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.documents(spark, sf_dir), with_text=False).drop("lost")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.documents(spark, sf_dir))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(common.documents(spark, sf_dir), common.new_path(spark, "token-store"))
    return token_store.read_digests(manifest)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.new_path(spark, "warc"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_sampling, op2_best_fit_packing, op3_minhash_near_dedup, op4_language_id, op5_quality_rules,
        op6_license_scan, op7_token_store, op8_suffix_array_dedup, op9_warc, op10_media_copies,
        op11_hard_negatives, op12_simhash_near_dedup, op13_spelling_variants,
    )
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _op3_sql() -> str:
    return r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, sh FROM (
      SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
    n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.k + q.k - c)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
    SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id"""


def _op5_sql() -> str:
    q = quality.Rules()
    spaces = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    chars = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
    signs = lambda x: f"(length({x}) - length(regexp_replace({x}, '[#*$%&|<>]', '', 'g')))"
    ends = " OR ".join(f"ends_with(bare, '{c.replace(chr(39), chr(39) * 2)}')" for c in quality.ENDS)
    times = lambda x, values: "(" + " + ".join(f"(length({x}) - length(replace({x}, {_quoted([v])}, ''))) // {len(v)}" for v in values) + ")"
    words = lambda x: f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"
    stock = "(" + " + ".join(f"(length(flat) - length(replace(flat, ' {v} ', ''))) // {len(v) + 2} * {len(v.split())}" for v in quality.STOCK) + ")"
    holds = lambda x, values: f"list_bool_or([{', '.join(f'contains({x}, {_quoted([v])})' for v in values)}])"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
    tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
    key AS (SELECT doc_id, i, [ws[i], ws[i+1], ws[i+2]] AS k FROM tri),
    hit AS (SELECT doc_id, i FROM key QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM hit) GROUP BY doc_id),
    ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
    f AS (SELECT doc_id, line, trim(line, {spaces}) AS bare, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS turn FROM ln WHERE trim(line, {spaces}) <> ''),
    g AS (SELECT doc_id, turn, bare, {chars('bare')} AS n, {signs('bare')} AS s, {words('bare')} AS ws, ltrim(bare, {spaces} || {_quoted([''.join(quality.SEPARATORS)])}) AS inn,
      regexp_extract_all(lower(bare), '\p{{L}}+') AS plain FROM f),
    h AS (SELECT *, len(ws) AS k, {times('inn', quality.SEPARATORS)} AS sep, len(list_filter({words('inn')}, lambda x: regexp_replace(x, '[{''.join(quality.SEPARATORS)}]+', '', 'g') <> '')) AS between,
      len(list_filter(ws, lambda x: right(x, 1) IN ('.', '!', '?'))) AS sentences, ' ' || array_to_string(plain, ' ') || ' ' AS flat FROM g),
    pass AS (SELECT doc_id, turn > 1 AS again, n, turn = 1 AND s <= {q.most_symbols} * n AND ({ends} OR {holds('bare', quality.INNER)})
      AND NOT (sep > 0 AND between <= {q.nav_words} * (sep + 1)) AND NOT (sentences >= {q.nav_sentences} AND 2 * k <= 3 * sentences)
      AND 100 * {stock} <= {q.most_stock} * len(plain) AND {times('bare', quality.LINKS)} <= {q.most_links} * k AS good FROM h),
    l AS (SELECT doc_id, count(*) FILTER (again) AS dup, coalesce(sum(n) FILTER (good), 0) AS kept_chars FROM pass GROUP BY doc_id),
    o AS (SELECT w.doc_id, len(ws) AS n_words, {chars('t')} AS word_chars, {signs('t')} AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
    b AS (SELECT *, n_words < {q.min_words} OR 100 * n_repeat_words > {q.most_repeat} * n_words AS base_failed FROM o)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND word_chars > 0 AND 1 - kept_chars::DOUBLE / word_chars <= {q.max_lost} AS kept FROM b"""


def _op6_sql() -> str:
    rows = ", ".join(f"({_quoted([k, ' '.join(licenses.words_of(v))])})" for k, v in licenses.TEMPLATES.items())
    return rf"""
    WITH tw AS (SELECT license, string_split(t, ' ') AS ws FROM (VALUES {rows}) AS v(license, t)),
    ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS sh FROM tw WHERE len(ws) >= 5),
    tm AS (SELECT license, count(*) AS m FROM ts GROUP BY license),
    w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(range(0, len(ws) - 4)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS sh FROM w WHERE len(ws) >= 5),
    h AS (SELECT doc_id, license, m, i, sh FROM s JOIN ts USING (sh) JOIN tm USING (license)),
    win AS (SELECT DISTINCT doc_id, license, m, greatest(1, m // 4) AS step, g * greatest(1, m // 4) AS a FROM
      (SELECT doc_id, license, m, unnest(range(greatest(0, (i - m + 1) // greatest(1, m // 4)), i // greatest(1, m // 4) + 1)) AS g FROM h)),
    c AS (SELECT win.doc_id, win.license, win.m, win.a, count(DISTINCT h.sh) AS shared FROM win JOIN h ON h.doc_id = win.doc_id AND h.license = win.license
      AND h.i >= win.a - win.m AND h.i < win.a + 2 * win.m GROUP BY 1, 2, 3, 4),
    best AS (SELECT doc_id, license, max(shared) AS shared, any_value(m) AS "of" FROM c WHERE 100 * shared >= 75 * m GROUP BY doc_id, license),
    held AS (SELECT DISTINCT h.doc_id, h.license, h.sh FROM c JOIN h ON h.doc_id = c.doc_id AND h.license = c.license AND h.i >= c.a - c.m AND h.i < c.a + 2 * c.m WHERE 100 * c.shared >= 75 * c.m),
    n AS (SELECT doc_id, license, count(*) AS n FROM held GROUP BY doc_id, license),
    two AS (SELECT x.doc_id, x.license, y.license AS other, count(*) AS k FROM held x JOIN held y ON x.doc_id = y.doc_id AND x.sh = y.sh AND x.license <> y.license GROUP BY 1, 2, 3),
    worse AS (SELECT DISTINCT two.doc_id, two.license FROM two JOIN n ON n.doc_id = two.doc_id AND n.license = two.license JOIN n o ON o.doc_id = two.doc_id AND o.license = two.other
      JOIN best x ON x.doc_id = two.doc_id AND x.license = two.license JOIN best y ON y.doc_id = two.doc_id AND y.license = two.other
      WHERE k = n.n AND (o.n > n.n AND y.shared * x."of" >= x.shared * y."of" OR y.shared * x."of" > x.shared * y."of"))
    SELECT best.* FROM best LEFT JOIN worse w ON w.doc_id = best.doc_id AND w.license = best.license WHERE w.doc_id IS NULL"""


_OP9_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
    SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.d = f.d"""


_OP11_SQL = """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.lab = b.lab AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM (SELECT * FROM r WHERE vec_id % 100 = 0) a JOIN r b ON a.vec_id <> b.vec_id),
    p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT * FROM n WHERE rank <= 10"""

def _xxh64_sql(source: str, seed: int) -> str:
    """CTEs that end in hashed (sh, h): XXH64 of the UTF-8 bytes of the column sh of a source. Numbers of 128 bits, cut to 64 after each step."""
    wrap, p = 1 << 64, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    big = lambda v: f"{v % wrap}::UHUGEINT"
    p1, p2, p3, p4, p5 = map(big, p)
    mul, add = (lambda x, y: f"(({x}) * ({y}) % {wrap}::UHUGEINT)"), (lambda x, y: f"(({x}) + ({y})) % {wrap}::UHUGEINT")
    turn = lambda x, r: f"(({x}) * {big(1 << r)} % {wrap}::UHUGEINT + ({x}) // {big(1 << (64 - r))})"
    number = lambda at, size: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"
    fold = lambda first, rest, step: f"list_reduce(list_prepend({first}, {rest}), lambda h, y: {step})"
    each = lambda v, y: mul(turn(add(v, mul(y, p2)), 31), p1)
    starts = (seed + p[0] + p[1], seed + p[1], seed, seed - p[0])
    lanes = ", ".join(f"{fold(big(v), f'list_transform(range(n // 32), lambda j: lanes[4 * j + {k + 1}])', each('h', 'y'))} AS v{k}" for k, v in enumerate(starts))
    h = "(" + " + ".join(turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))) + f") % {wrap}::UHUGEINT"
    joined = [f"x0 AS (SELECT sh, hex(sh) AS x, octet_length(encode(sh)) AS n FROM (SELECT DISTINCT sh FROM {source}))", f"x1 AS (SELECT *, list_transform(range(n // 8), lambda j: {number('8 * j', 8)}) AS lanes FROM x0)"]
    joined += [f"x2 AS (SELECT *, {lanes} FROM x1)", f"y0 AS (SELECT *, {h} AS h FROM x2)"]
    for k in range(4):
        joined.append(f"y{k + 1} AS (SELECT * REPLACE ({add(mul(f'xor(h, {each(big(0), f"v{k}")})', p1), p4)} AS h) FROM y{k})")
    joined.append(f"z1 AS (SELECT sh, x, n, lanes, {add(f'CASE WHEN n >= 32 THEN h ELSE {big(seed + p[4])} END', 'n::UHUGEINT')} AS h FROM y4)")
    joined.append(f"z2 AS (SELECT * REPLACE ({fold('h', 'lanes[4 * (n // 32) + 1 :]', add(mul(turn(f'xor(h, {each(big(0), "y")})', 27), p1), p4))} AS h) FROM z1)")
    joined.append(f"z3 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {add(mul(turn(f'xor(h, {mul(number("n // 8 * 8", 4), p1)})', 23), p2), p3)} ELSE h END AS h) FROM z2)")
    joined.append(f"z4 AS (SELECT * REPLACE ({fold('h', f'list_transform(range(n % 4), lambda j: {number("n // 4 * 4 + j", 1)})', mul(turn(f'xor(h, {mul("y", p5)})', 11), p1))} AS h) FROM z3)")
    for k, (r, by) in enumerate(((33, p2), (29, p3))):
        joined.append(f"z{k + 5} AS (SELECT * REPLACE ({mul(f'xor(h, h // {big(1 << r)})', by)} AS h) FROM z{k + 4})")
    joined.append(f"hashed AS (SELECT sh, xor(h, h // {big(1 << 32)})::UBIGINT AS h FROM z6)")
    return ",\n    ".join(joined)


def _op12_sql() -> str:
    ones = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
    print_ = " + ".join(f"CASE WHEN 2 * b{b} > k THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
    {_xxh64_sql("s", 42)},
    c AS (SELECT doc_id, count(*) AS k, {ones} FROM s JOIN hashed USING (sh) GROUP BY doc_id),
    f AS (SELECT d.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN (SELECT doc_id, ({print_})::UBIGINT AS fp FROM c) USING (doc_id)),
    q AS (SELECT fp, part, (fp >> (16 * part)) & 65535 AS v FROM (SELECT DISTINCT fp FROM f), range(4) r(part)),
    e AS (SELECT DISTINCT a.fp AS a, b.fp AS b FROM q a JOIN q b ON a.part = b.part AND a.v = b.v AND a.fp <> b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 3),
    r AS (SELECT DISTINCT fp AS a, fp AS b FROM f UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT r.a, min(f.doc_id) AS c FROM r JOIN f ON f.fp = r.b GROUP BY r.a)
    SELECT f.doc_id, lower(lpad(hex(f.fp), 16, '0')) AS fingerprint, m.c AS component_id FROM f JOIN m ON m.a = f.fp"""


#: The checksum has no function in SQL: its table is made by its rule, and bytes are taken one by one.
_OP13_SQL = """
    WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
    o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    u AS (SELECT doc_id, run, count(*) AS n, list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x)) AS chars FROM o WHERE length(run) >= 7 GROUP BY doc_id, run),
    b AS (SELECT doc_id, run, n, flatten(list_transform(chars, lambda c: CASE WHEN c < 128 THEN [c::BIGINT] ELSE [195::BIGINT, c::BIGINT - 64] END)) AS bytes FROM u),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, t),
    d AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    x AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    e AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.rest = w.word),
    k AS (SELECT a AS word, count(*) AS n_near, min({'m': -w.n, 'other': b}) AS top FROM e JOIN w ON w.word = e.b GROUP BY a),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 10 * w.n THEN top.other END AS form, CASE WHEN -top.m >= 10 * w.n THEN -top.m END AS form_n FROM w LEFT JOIN k ON k.word = w.word),
    z AS (SELECT word, word AS root FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT z.word, z.root FROM z JOIN f ON f.word = z.root WHERE f.form IS NULL) z ON z.word = f.word"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minhash_near_dedup": _op3_sql(), "op5_quality_rules": _op5_sql(), "op6_license_scan": _op6_sql(), "op9_warc": _OP9_SQL,
        "op11_hard_negatives": _OP11_SQL, "op12_simhash_near_dedup": _op12_sql(), "op13_spelling_variants": _OP13_SQL,
    }
