"""Problem 6: licences typed in registry documents mapped to the reference list.

`P6_SQL` states the same result for DuckDB, by comparing every value with every spelling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import cut, table
from .fuzzy import SALT, map_values

# Other public names of well-known licences.
PUBLIC_NAMES = """
MIT: mit x11; x11; expat; expat mit; mit expat
Apache-2.0: asl {2.0}; apache {2.0}; apache software license {2.0}; al {2.0}
BSD-2-Clause: bsd 2 clause; bsd 2; 2 clause bsd; 2 clause bsd license; simplified bsd; simplified bsd license; freebsd; freebsd license
BSD-3-Clause: bsd 3 clause; bsd 3; 3 clause bsd; 3 clause bsd license; new bsd; new bsd license; revised bsd; revised bsd license; modified bsd; modified bsd license
ISC: isc iscl; iscl; isc license iscl
MPL-2.0: mpl {2.0}; mozilla public license {2.0}; mozilla {2.0}
GPL-2.0-only: gpl {2.0}; gnu gpl {2.0}; gnu general public license {2.0}; gpl {2.0} only; general public license {2.0}
GPL-3.0-only: gpl {3.0}; gnu gpl {3.0}; gnu general public license {3.0}; gpl {3.0} only; general public license {3.0}
LGPL-2.1-only: lgpl {2.1}; gnu lgpl {2.1}; gnu lesser gpl {2.1}; lesser gpl {2.1}; gnu lesser general public license {2.1}; lgpl {2.1} only
LGPL-3.0-only: lgpl {3.0}; gnu lgpl {3.0}; gnu lesser gpl {3.0}; lesser gpl {3.0}; gnu lesser general public license {3.0}; lgpl {3.0} only
AGPL-3.0-only: agpl {3.0}; gnu agpl {3.0}; affero gpl {3.0}; gnu affero gpl {3.0}; gnu affero general public license {3.0}; affero general public license {3.0}; agpl {3.0} only
EPL-2.0: epl {2.0}; eclipse public license {2.0}; eclipse {2.0}
CC0-1.0: cc0; cc zero; creative commons zero; cc0 {1.0}; cc0 {1.0} universal; public domain cc0
CC-BY-4.0: cc by {4.0}; creative commons attribution {4.0}; creative commons by {4.0}
BSL-1.0: boost; boost {1.0}; boost license {1.0}; boost license; boost software license; bsl {1.0}
Zlib: zlib license; zlib libpng
EUPL-1.2: eupl {1.2}; european union public license {1.2}
"""

#: Setting that lets a payload with a repeated key be read.
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"

TYPED = """
WITH doc AS (SELECT record_id, try_parse_json(payload) AS j FROM {docs}),
held AS (
  SELECT record_id,
         coalesce(v.key, try_variant_get(v.value, '$.version', 'string')) AS version,
         variant_get(v.value, '$.license') AS l
  FROM (SELECT record_id, variant_get(j, '$.versions') AS vs FROM doc WHERE j IS NOT NULL), LATERAL variant_explode(vs) v
  UNION ALL
  SELECT record_id, try_variant_get(j, '$.info.version', 'string'), variant_get(j, '$.info.license') FROM doc WHERE j IS NOT NULL),
named AS (
  SELECT DISTINCT record_id, version,
         CASE WHEN schema_of_variant(l) LIKE 'OBJECT%' THEN try_variant_get(l, '$.type', 'string')
              WHEN schema_of_variant(l) = 'STRING' THEN CAST(l AS STRING)
              WHEN schema_of_variant(l) <> 'VOID' THEN to_json(l) END AS raw
  FROM held WHERE l IS NOT NULL)
SELECT record_id, version, raw FROM named WHERE raw IS NOT NULL AND trim(regexp_replace(raw, '\\\\s', ' ')) <> ''
"""

#: A value without what is no part of the name: phrases around it, layout, zero minor versions.
PLAIN = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_replace(lower({v}), '[\\s_]+', ' ')),
  '^\\W*(licen[cs]e *:+ *|licen[cs]ed under (the )?|released under (the )?|distributed under (the )?)', ''),
  '\\(?see (the )?licen[cs]e[a-z. ]*(file)?\\)?\\W*$', ''),
  'licence', 'license'), '([0-9])\\.0+(?!\\.?[0-9])', '$1'), '([0-9])\\.([0-9])', '$1$2'), '[^\\p{{L}}0-9?]+', '')
"""

SPELLINGS = r"""
WITH base AS (
  SELECT license_id AS entry, lower(full_name) AS full, lower(license_id) AS id,
         regexp_extract(full_name, '([0-9]+(\\.[0-9]+)?)', 1) AS version,
         startswith(license_id, 'LicenseRef-') AS own
  FROM {reference}),
words AS (SELECT *, split(trim(regexp_replace(regexp_replace(full, 'v?[0-9]+\\.[0-9]+', ' '), '[^a-z]+', ' ')), ' ') AS w FROM base),
bare AS (
  SELECT entry, own, version, array_join(w, ' ') AS name, w[0] AS maker,
         array_join(filter(w, x -> x <> 'license'), ' ') AS short,
         array_join(transform(slice(w, 2, 10), x -> left(x, 1)), '') AS rest_letters,
         array_join(transform(w, x -> left(x, 1)), '') AS letters
  FROM words),
raw AS (
  SELECT entry, id AS s FROM base UNION ALL SELECT entry, full FROM base
  UNION ALL SELECT entry, replace(id, 'licenseref-', '') FROM base WHERE own
  UNION ALL SELECT entry, concat(s, ' {{', version, '}}') FROM bare LATERAL VIEW explode(array(name, short)) e AS s WHERE version <> '' AND NOT entry LIKE 'BSD%'
  UNION ALL SELECT entry, s FROM bare LATERAL VIEW explode(array(name, short)) e AS s WHERE NOT entry LIKE 'BSD%' AND size(split(s, ' ')) > 1
  UNION ALL SELECT entry, s FROM bare LATERAL VIEW explode(array(
      concat(maker, ' ', rest_letters), concat(maker, ' {{', version, '}}'), concat(maker, ' ', rest_letters, ' {{', version, '}}'),
      concat(letters, ' {{', version, '}} ', maker), concat(letters, ' ', maker), letters, concat(letters, ' {{', version, '}}'))) e AS s WHERE own
  UNION ALL SELECT entry, s FROM {names}),
versioned AS (
  SELECT entry, replace(replace(replace(s, '{{', m), '}}', ''), '  ', ' ') AS s
  FROM raw LATERAL VIEW explode(array('', 'v', 'version ', 'v.')) e AS m),
led AS (SELECT entry, concat(lead, s) AS s FROM versioned LATERAL VIEW explode(array('', 'the ')) e AS lead),
normal AS (SELECT DISTINCT entry, {plain} AS spelling FROM led),
-- typing errors within `licence` are measured against either way of writing it
plain AS (SELECT entry, spelling FROM normal UNION SELECT entry, replace(spelling, 'license', 'licence') FROM normal)
-- a spelling that several entries could mean stands for none of them
SELECT spelling, min(entry) AS entry FROM plain WHERE spelling <> '' GROUP BY spelling HAVING count(DISTINCT entry) = 1
"""


def spellings(spark: SparkSession, reference: DataFrame) -> DataFrame:
    """(spelling, entry): normalised spellings of each entry, from its id and full name by
    rule (with and without version, initials of makers' own licences) and from public names."""
    names = spark.createDataFrame(_public_names(), "entry string, s string")
    names = names.join(reference, names.entry == reference.license_id, "left_semi")
    return spark.sql(SPELLINGS.replace("{plain}", PLAIN.replace("{v}", "s")), names=names, reference=reference)


def map_licences(spark: SparkSession, docs: DataFrame, reference: DataFrame) -> DataFrame:
    """(record_id, version, raw, license_id) of every licence typed in `docs.payload`.

    Null, blank and unreadable ones give no rows; a value that holds no letter or digit, or
    means no entry, comes out as `unmatched`. An array, number or boolean is taken as its JSON
    text. Of a key repeated in an object the last value counts.
    """
    before = spark.conf.get(REPEATED_KEYS)
    spark.conf.set(REPEATED_KEYS, "true")
    try:
        held = cut(spark.sql(TYPED, docs=docs))
    finally:
        spark.conf.set(REPEATED_KEYS, before)
    values = cut(spark.sql("SELECT raw, " + PLAIN.replace("{v}", "raw") + " AS value FROM (SELECT DISTINCT raw FROM {held})", held=held))
    mapped = cut(map_values(spark, values.select("value"), spellings(spark, reference)))
    return spark.sql(
        """
        SELECT h.record_id, h.version, h.raw, m.entry AS license_id
        FROM (SELECT *, CAST(pmod(xxhash64(record_id, version), {salt}) AS INT) AS salt FROM {held}) h
        JOIN (SELECT v.raw, coalesce(m.entry, 'unmatched') AS entry, salt
              FROM {vals} v LEFT JOIN {mapped} m ON m.value = v.value LATERAL VIEW explode(sequence(0, {salt} - 1)) s AS salt) m
          ON h.raw = m.raw AND h.salt = m.salt""",
        held=held, vals=values, mapped=mapped, salt=SALT,
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """(record_id, version, license_id) of every licence typed in a registry document."""
    return map_licences(spark, table(spark, root, "registry_docs"), table(spark, root, "license_reference")).select("record_id", "version", "license_id").distinct()


def _public_names() -> list[tuple[str, str]]:
    return [(e.strip(), s.strip()) for line in PUBLIC_NAMES.strip().splitlines() for e, _, names in [line.partition(":")] for s in names.split(";")]


def _plain_sql(v: str) -> str:
    """`PLAIN` in DuckDB's expressions, which have no look-ahead."""
    out = f"trim(regexp_replace(lower({v}), '[\\s_]+', ' ', 'g'))"
    for pattern, by in (
        ("^\\W*(licen[cs]e *:+ *|licen[cs]ed under (the )?|released under (the )?|distributed under (the )?)", ""), ("\\(?see (the )?licen[cs]e[a-z. ]*(file)?\\)?\\W*$", ""), ("licence", "license"),
        ("([0-9])\\.0+($|[^0-9.]|\\.($|[^0-9]))", "\\1\\2"), ("([0-9])\\.([0-9])", "\\1\\2"), ("[^\\p{L}0-9?]+", ""),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


_DIGITS = lambda v: f"regexp_replace({v}, '[^0-9]', '', 'g')"
P6_SQL = f"""
WITH base AS (SELECT license_id AS entry, lower(full_name) AS whole, lower(license_id) AS id, regexp_extract(full_name, '([0-9]+([.][0-9]+)?)', 1) AS version, starts_with(license_id, 'LicenseRef-') AS own FROM license_reference),
words AS (SELECT *, string_split(trim(regexp_replace(regexp_replace(whole, 'v?[0-9]+[.][0-9]+', ' ', 'g'), '[^a-z]+', ' ', 'g')), ' ') AS w FROM base),
bare AS (SELECT entry, own, version, array_to_string(w, ' ') AS name, w[1] AS maker, array_to_string(list_filter(w, lambda x: x <> 'license'), ' ') AS short,
  array_to_string(list_transform(w[2:11], lambda x: left(x, 1)), '') AS rest, array_to_string(list_transform(w, lambda x: left(x, 1)), '') AS letters FROM words),
names AS (SELECT n.e AS entry, n.s FROM (VALUES {", ".join(f"('{e}', '{s}')" for e, s in _public_names())}) n(e, s) WHERE n.e IN (SELECT license_id FROM license_reference)),
raw AS (
  SELECT entry, id AS s FROM base UNION ALL SELECT entry, whole FROM base UNION ALL SELECT entry, replace(id, 'licenseref-', '') FROM base WHERE own
  UNION ALL SELECT entry, unnest([name, short]) || ' {{' || version || '}}' FROM bare WHERE version <> '' AND entry NOT LIKE 'BSD%'
  UNION ALL SELECT entry, s FROM (SELECT entry, unnest([name, short]) AS s FROM bare WHERE entry NOT LIKE 'BSD%') WHERE contains(s, ' ')
  UNION ALL SELECT entry, unnest([maker || ' ' || rest, maker || ' {{' || version || '}}', maker || ' ' || rest || ' {{' || version || '}}', letters || ' {{' || version || '}} ' || maker, letters || ' ' || maker, letters, letters || ' {{' || version || '}}']) FROM bare WHERE own
  UNION ALL SELECT entry, s FROM names),
versioned AS (SELECT entry, replace(replace(replace(s, '{{', m), '}}', ''), '  ', ' ') AS s FROM raw, (VALUES (''), ('v'), ('version '), ('v.')) t(m)),
led AS (SELECT entry, lead || s AS s FROM versioned, (VALUES (''), ('the ')) t(lead)),
normal AS (SELECT DISTINCT entry, {_plain_sql('s')} AS spelling FROM led),
either AS (SELECT entry, spelling FROM normal UNION SELECT entry, replace(spelling, 'license', 'licence') FROM normal),
spelled AS (SELECT spelling, min(entry) AS entry, CASE WHEN length(spelling) < 5 THEN 0 WHEN length(spelling) < 6 THEN 1 ELSE 2 END AS k, {_DIGITS('spelling')} AS digits FROM either WHERE spelling <> '' GROUP BY spelling HAVING count(DISTINCT entry) = 1),
doc AS (SELECT DISTINCT record_id, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
held AS (
  SELECT record_id, coalesce(CASE WHEN json_type(j, '$.versions') = 'OBJECT' THEN key END, value->>'version') AS version, value->'license' AS l FROM doc, json_each(j, '$.versions') WHERE json_type(value) = 'OBJECT'
  UNION ALL SELECT record_id, j->>'$.info.version', j->'$.info.license' FROM doc),
typed AS (SELECT DISTINCT record_id, version, CASE json_type(l) WHEN 'OBJECT' THEN l->>'$.type' WHEN 'VARCHAR' THEN l->>'$' WHEN 'NULL' THEN NULL ELSE l::VARCHAR END AS raw FROM held WHERE l IS NOT NULL),
put AS (SELECT record_id, version, raw, {_plain_sql('raw')} AS value FROM typed WHERE trim(regexp_replace(raw, '\\s', ' ', 'g')) <> ''),
vals AS (SELECT DISTINCT value, {_DIGITS('value')} AS digits FROM put WHERE value <> ''),
best AS (SELECT value, arg_min(entry, (levenshtein(value, spelling), entry)) AS entry FROM vals v JOIN spelled s ON s.digits = v.digits WHERE levenshtein(value, spelling) <= k GROUP BY value)
SELECT DISTINCT record_id, version, coalesce(entry, 'unmatched') AS license_id FROM put LEFT JOIN best USING (value)
"""
