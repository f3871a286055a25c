"""A deterministic record view over the documents table: three sources of business records.

Each distinct text gives a reference record (S1) and, by rules on its id, noisy records of two other
sources and decoys; ``owner`` is the S1 id a record belongs to, null for S1 and for decoys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, src, country, business_name, business_address, owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    words = F.expr("slice(filter(split(regexp_replace(lower(text), '[^a-z0-9]+', ' '), ' '), t -> length(t) > 2), 1, 5)")
    # one small row for each text is all that is shuffled
    first = docs.select(F.md5("text").alias("h"), F.struct("doc_id", "lang", words.alias("t")).alias("d")).groupBy("h").agg(F.min_by("d", "d.doc_id").alias("d"))
    d = first.select("d.*").where("size(t) = 5").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.expr("array_join(slice(t, 1, 3), ' ')").alias("name"), F.expr("concat_ws(' ', t[1], t[0], t[2])").alias("turned"), F.col("t")[3].alias("t4"), F.col("t")[4].alias("t5"), F.expr("1 + (doc_id * 7919) % 980").alias("hn"), F.expr("10000 + (doc_id * 104729) % 89999").alias("zip")
    )
    parts = """array(
      struct(concat('S1-', id) AS entity_id, 1 AS src, concat(name, CASE id % 3 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Inc' ELSE '' END) AS business_name,
             concat(hn, ' ', t4, ' Road, ', t5, ' ', zip) AS business_address, cast(null AS string) AS owner),
      CASE WHEN id % 4 <> 0 THEN struct(concat('S2-', id) AS entity_id, 2 AS src, concat(name, CASE id % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Incorporated' ELSE ' Co' END) AS business_name,
             CASE WHEN id % 29 = 0 THEN '' ELSE concat(hn, ', ', t4, ' Rd ', t5, ' ', zip) END AS business_address, concat('S1-', id) AS owner) END,
      CASE WHEN id % 3 <> 1 THEN struct(concat('S3-', id) AS entity_id, 3 AS src, concat('M/s ', turned, CASE WHEN id % 2 = 0 THEN ' Services' ELSE '' END) AS business_name,
             concat('0', hn, ' ', t4, ' road ', t5) AS business_address, concat('S1-', id) AS owner) END,
      CASE WHEN id % 7 = 0 THEN struct(concat('S2-', id + 20000000) AS entity_id, 2 AS src, name AS business_name,
             concat(hn + 3, ' ', t4, ' Rd ', t5, ' ', zip) AS business_address, cast(null AS string) AS owner) END,
      CASE WHEN id % 5 = 0 THEN struct(concat('S3-', id + 10000000) AS entity_id, 3 AS src, concat(name, ' Exports Pvt Ltd') AS business_name,
             concat('12 ', t5, ' Street') AS business_address, cast(null AS string) AS owner) END)"""
    return d.select("country", F.explode(F.expr(f"filter({parts}, x -> x IS NOT NULL)")).alias("r")).select("r.entity_id", "r.src", "country", "r.business_name", "r.business_address", "r.owner")


RECORDS_SQL = """
tok AS (
  SELECT doc_id AS id, lang AS country, t FROM (
    SELECT doc_id, lang, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2)[1:5] AS t,
           row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
    FROM documents WHERE text IS NOT NULL) WHERE rn = 1 AND len(t) = 5
), d AS (
  SELECT id, country, concat_ws(' ', t[1], t[2], t[3]) AS name, concat_ws(' ', t[2], t[1], t[3]) AS turned, t[4] AS t4, t[5] AS t5,
         1 + (id * 7919) % 980 AS hn, 10000 + (id * 104729) % 89999 AS zip
  FROM tok
), records AS (
  SELECT 'S1-' || id AS entity_id, 1 AS src, country, name || CASE id % 3 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Inc' ELSE '' END AS business_name,
         hn || ' ' || t4 || ' Road, ' || t5 || ' ' || zip AS business_address, NULL::VARCHAR AS owner FROM d
  UNION ALL SELECT 'S2-' || id, 2, country, name || CASE id % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Incorporated' ELSE ' Co' END,
         CASE WHEN id % 29 = 0 THEN '' ELSE hn || ', ' || t4 || ' Rd ' || t5 || ' ' || zip END, 'S1-' || id FROM d WHERE id % 4 <> 0
  UNION ALL SELECT 'S3-' || id, 3, country, 'M/s ' || turned || CASE WHEN id % 2 = 0 THEN ' Services' ELSE '' END,
         '0' || hn || ' ' || t4 || ' road ' || t5, 'S1-' || id FROM d WHERE id % 3 <> 1
  UNION ALL SELECT 'S2-' || (id + 20000000), 2, country, name, (hn + 3) || ' ' || t4 || ' Rd ' || t5 || ' ' || zip, NULL FROM d WHERE id % 7 = 0
  UNION ALL SELECT 'S3-' || (id + 10000000), 3, country, name || ' Exports Pvt Ltd', '12 ' || t5 || ' Street', NULL FROM d WHERE id % 5 = 0
)"""


# letters and the Devanagari consonants that stand for them; romanised, an inherent a follows each but the last
_LATIN, _NATIVE = "kgjtdnpbmyrlvsh", "कगजतदनपबमयरलवसह"


def noisy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with further noise in names and addresses, by rules on the id's number.

    Domains, second names, dotted acronyms, digits for letters, accents, native script, forms of
    address and symbols; names of states, ordinals and numbers in other forms.
    """
    rec = records(spark, sf_dir).withColumn("k", F.expr("cast(split(entity_id, '-')[1] AS long) % 10")).withColumn("t", F.split(F.lower(F.regexp_replace("business_name", "^M/s ", "")), " "))
    name = f"""CASE k WHEN 0 THEN concat('https://www.', t[0], t[1], '.co.in') WHEN 1 THEN concat(business_name, ' d/b/a ', t[1], ' Inc')
      WHEN 2 THEN concat('S.A.R.L. ', t[0], ' J.K.') WHEN 3 THEN translate(lower(business_name), 'oes', '035') WHEN 4 THEN translate(business_name, 'aeiou', 'àéîöü')
      WHEN 5 THEN concat(translate(concat(regexp_replace(t[0], '[^{_LATIN}]', ''), 'k'), '{_LATIN}', '{_NATIVE}'), ' ', business_name) WHEN 6 THEN concat('Shri Messrs ', t[0], ' & ', t[1], '+', t[2], ' @ 2024')
      WHEN 7 THEN concat(t[0], '.com ', t[1], ' Corporation') ELSE business_name END"""
    address = f"""CASE k WHEN 1 THEN concat(business_address, ', West Bengal 560 001') WHEN 2 THEN concat('1st Floor # 12 ', business_address) WHEN 3 THEN concat(business_address, ' New Hampshire texas')
      WHEN 4 THEN concat('Suite 5-B, ', translate(business_address, 'aeiou', 'àéîöü')) WHEN 5 THEN concat('n° 007 fifth ', business_address, ' Tamil Nadu') WHEN 6 THEN concat(translate(concat(regexp_replace(t[1], '[^{_LATIN}]', ''), 'k'), '{_LATIN}', '{_NATIVE}'), ' rd') ELSE business_address END"""
    return rec.withColumns({"business_name": F.expr(name), "business_address": F.expr(address)}).drop("k", "t")


def native_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(latin_text, native_text): names of owned records in native script beside their S1 record's in Latin letters."""
    letters = F.concat(F.regexp_replace(F.split(F.lower(F.regexp_replace("business_name", "^M/s ", "")), " ")[0], f"[^{_LATIN}]", ""), F.lit("k"))
    rec = records(spark, sf_dir).withColumn("letters", letters)
    native = rec.where("owner IS NOT NULL").select("owner", F.concat_ws(" ", F.translate("letters", _LATIN, _NATIVE), "business_name").alias("native_text"))
    latin = rec.where("src = 1").select(F.col("entity_id").alias("owner"), F.concat_ws(" ", F.expr("array_join(split(letters, ''), 'a')"), F.col("business_name")).alias("latin_text"))
    return native.join(latin, "owner").select("latin_text", "native_text")


# the same noise where the SQL's normaliser knows it, and what it stands for where it does not (domains, dots, accents, native script)
NOISY_SQL = f"""
tokens AS (SELECT *, split_part(entity_id, '-', 2)::BIGINT % 10 AS k, string_split(lower(regexp_replace(business_name, '^M/s ', '')), ' ') AS t FROM records
), letters AS (SELECT *, array_to_string(string_split(regexp_replace(t[1], '[^{_LATIN}]', '', 'g') || 'k', ''), 'a') AS l1, array_to_string(string_split(regexp_replace(t[2], '[^{_LATIN}]', '', 'g') || 'k', ''), 'a') AS l2 FROM tokens
), noisy AS (SELECT entity_id, src, country, owner, (k IN (0, 7))::TINYINT AS is_dom,
    CASE k WHEN 0 THEN t[1] || t[2] WHEN 1 THEN business_name || ' d/b/a ' || t[2] || ' Inc' WHEN 2 THEN 'sarl ' || t[1] || ' jk' WHEN 3 THEN translate(lower(business_name), 'oes', '035') WHEN 4 THEN business_name
      WHEN 5 THEN l1 || ' ' || business_name WHEN 6 THEN 'Shri Messrs ' || t[1] || ' & ' || t[2] || '+' || t[3] || ' @ 2024' WHEN 7 THEN t[1] || ' ' || t[2] || ' Corporation' ELSE business_name END AS business_name,
    CASE k WHEN 1 THEN business_address || ', wb 560 001' WHEN 2 THEN '1st Floor # 12 ' || business_address WHEN 3 THEN business_address || ' nh texas' WHEN 4 THEN 'Suite 5-B, ' || business_address WHEN 5 THEN ' no  007 fifth ' || business_address || ' tn' WHEN 6 THEN l2 || ' rd' ELSE business_address END AS business_address
  FROM letters
)"""

NATIVE_SQL = f"""
lt AS (SELECT *, regexp_replace(string_split(lower(regexp_replace(business_name, '^M/s ', '')), ' ')[1], '[^{_LATIN}]', '', 'g') || 'k' AS letters FROM records
), np AS (SELECT translate(n.letters, '{_LATIN}', '{_NATIVE}') AS native, array_to_string(string_split(n.letters, ''), 'a') AS sound,
    list_filter(string_split(lower(array_to_string(string_split(l.letters, ''), 'a') || ' ' || l.business_name), ' '), lambda t: NOT list_contains(string_split_regex(lower(regexp_replace(n.business_name, '[^a-zA-Z0-9]', ' ', 'g')), '\\s+'), t)) AS latin
  FROM lt n JOIN lt l ON l.entity_id = n.owner AND l.src = 1
), seen AS (SELECT native, sound, count(*) AS seen FROM np GROUP BY ALL HAVING count(*) >= 3
), met AS (SELECT native, latin, count(*) AS met FROM (SELECT native, unnest(list_distinct(latin)) AS latin FROM np) GROUP BY ALL
), few AS (SELECT *, row_number() OVER (PARTITION BY native ORDER BY met DESC, latin) AS r FROM met
), judged AS (SELECT native, latin, met, (met::DOUBLE / seen) * (0.35 + CASE WHEN greatest(length(sound), length(latin)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(sound, latin)::DOUBLE / greatest(length(sound), length(latin)) END) AS score FROM few JOIN seen USING (native) WHERE r <= 8 AND met::DOUBLE / seen >= 0.3
)"""
