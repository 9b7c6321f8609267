"""Plain-SQL (DuckDB dialect) forms of the registered queries.

Each query re-derives the fixture registry from the driver's tables with
the same rules as ``sources/fixtures.py`` and computes the operator's
result independently (windows and correlated forms where the Spark side
uses aggregates and joins), so a shared mistake is unlikely.
"""

from __future__ import annotations

_FIELDS = "['station:string','reading:float','unit:string','taken_on:date','sensor_no:integer']"


def _schema(key: str) -> str:
    """The declared schema of a fixture dataset, fields in order of name."""
    return f"array_to_string(list_sort(({_FIELDS})[1:{key} % 5 + 1]), ',')"


# Fixture registry as CTEs -------------------------------------------------

_FORMATS = "['plaintext','json','ndjson','csv','tsv','protobuf']"
_COMPRESSIONS = "['uncompressed','zip','gzip']"
_CLASSES = "['confidential','internal','public','restricted']"
_FORMAT_EXT = "['txt','json','ndjson','csv','tsv','pb']"
_COMPRESSION_EXT = "['','zip','tar.gz']"

MANAGERS = """
managers_r AS (
  SELECT CAST(n_nationkey AS BIGINT) AS manager_id,
         lower(n_name) || '@example.com' AS manager_email,
         'key-' || CAST(n_nationkey AS VARCHAR) AS api_key,
         n_nationkey = 0 AS is_admin,
         TIMESTAMP '1993-01-01 00:00:00' + n_nationkey * INTERVAL 1 HOUR AS created_at,
         TIMESTAMP '1993-01-01 00:00:00' + n_nationkey * INTERVAL 1 HOUR AS updated_at
  FROM nation)"""

DATASETS = f"""
datasets_r AS (
  SELECT CAST(c_custkey AS BIGINT) AS dataset_id,
         c_name AS dataset_name,
         c_mktsegment AS dataset_desc,
         ({_FORMATS})[c_custkey % 6 + 1] AS dataset_format,
         ({_COMPRESSIONS})[c_custkey % 3 + 1] AS dataset_compression,
         ({_CLASSES})[c_custkey % 4 + 1] AS dataset_classification,
         CAST(c_custkey % 5 + 1 AS BIGINT) AS n_fields,
         {_schema("c_custkey")} AS dataset_schema,
         CAST(c_nationkey AS BIGINT) AS manager_id,
         TIMESTAMP '1994-01-01 00:00:00' + c_custkey * INTERVAL 1 MINUTE AS created_at,
         TIMESTAMP '1994-01-01 00:00:00' + c_custkey * INTERVAL 1 MINUTE AS updated_at
  FROM customer)"""

PARTITIONS = f"""
partitions_r AS (
  SELECT CAST(o_orderkey AS BIGINT) AS partition_id,
         'part-' || CAST(o_orderkey AS VARCHAR) || '.' ||
           concat_ws('.', ({_FORMAT_EXT})[o_custkey % 6 + 1],
                     nullif(({_COMPRESSION_EXT})[o_custkey % 3 + 1], '')) AS partition_name,
         'lake://' || ({_CLASSES})[o_custkey % 4 + 1] || '/ds-' ||
           CAST(o_custkey AS VARCHAR) || '/part-' || CAST(o_orderkey AS VARCHAR) || '.' ||
           concat_ws('.', ({_FORMAT_EXT})[o_custkey % 6 + 1],
                     nullif(({_COMPRESSION_EXT})[o_custkey % 3 + 1], '')) AS partition_url,
         CAST(round(o_totalprice * 100) AS BIGINT) AS partition_size,
         CAST(o_custkey AS BIGINT) AS dataset_id,
         o_orderdate AS created_at,
         o_orderdate AS updated_at
  FROM orders)"""

VIEW = """
view_r AS (
  SELECT d.dataset_id, d.dataset_name, d.manager_id, m.manager_email, d.dataset_compression,
         d.dataset_format, d.dataset_classification, d.dataset_schema, d.dataset_desc, d.created_at, d.updated_at
  FROM datasets_r d JOIN managers_r m ON d.manager_id = m.manager_id)"""

REGISTRY = "WITH " + ",".join([MANAGERS, DATASETS, PARTITIONS, VIEW])

_PCOLS = ("partition_id, partition_name, partition_url, partition_size, dataset_id, "
          "created_at, updated_at")
_VCOLS = ("dataset_id, dataset_name, manager_id, manager_email, dataset_compression, "
          "dataset_format, dataset_classification, dataset_schema, dataset_desc, created_at, updated_at")


def _q(body: str, *extra_ctes: str) -> str:
    ctes = REGISTRY + "".join("," + c for c in extra_ctes)
    return ctes + "\n" + body


SQL: dict[str, str] = {}

SQL["latest_partition"] = _q(f"""
SELECT p.partition_id, p.partition_name, p.partition_url, p.partition_size, p.dataset_id,
       p.created_at, p.updated_at, v.dataset_name, v.manager_email
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
                                   ORDER BY created_at DESC, partition_id DESC) AS rn
      FROM partitions_r) p
JOIN view_r v ON v.dataset_id = p.dataset_id
WHERE p.rn = 1""")

_POS = "row_number() OVER (ORDER BY updated_at DESC, dataset_id DESC)"
_PPOS = "row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, partition_id DESC)"
_PPOS_P = ("row_number() OVER (PARTITION BY p.dataset_id "
           "ORDER BY p.created_at DESC, p.partition_id DESC)")

SQL["list_datasets"] = _q(f"SELECT {_VCOLS} FROM view_r")

SQL["datasets_top"] = _q(f"""
SELECT * FROM (SELECT {_VCOLS}, {_POS} AS position FROM view_r) WHERE position <= 10""")

SQL["datasets_skip"] = _q(f"""
SELECT {_VCOLS} FROM (SELECT *, {_POS} AS position FROM view_r) WHERE position > 20""")

SQL["datasets_page"] = _q(f"""
SELECT * FROM (SELECT {_VCOLS}, {_POS} AS position FROM view_r)
WHERE position > 30 AND position <= 40""")

SQL["datasets_range"] = _q(f"""
SELECT * FROM (SELECT {_VCOLS}, {_POS} AS position FROM view_r
               WHERE created_at BETWEEN TIMESTAMP '1994-01-01 06:00:00'
                                    AND TIMESTAMP '1994-01-01 20:00:00')
WHERE position > 2 AND position <= 7""")

SQL["list_partitions"] = _q(f"""
SELECT p.*, d.dataset_name FROM partitions_r p JOIN datasets_r d ON d.dataset_id = p.dataset_id""")

SQL["partitions_range"] = _q(f"""
SELECT * FROM (
  SELECT p.*, d.dataset_name, {_PPOS_P} AS position
  FROM partitions_r p JOIN datasets_r d ON d.dataset_id = p.dataset_id
  WHERE p.created_at BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00')
WHERE position > 1 AND position <= 4""")

SQL["partitions_page"] = _q(f"""
SELECT * FROM (
  SELECT p.*, d.dataset_name, {_PPOS_P} AS position
  FROM partitions_r p JOIN datasets_r d ON d.dataset_id = p.dataset_id)
WHERE position > 1 AND position <= 3""")

SQL["partitions_skip"] = _q(f"""
SELECT {_PCOLS}, dataset_name FROM (
  SELECT p.*, d.dataset_name, {_PPOS_P} AS position
  FROM partitions_r p JOIN datasets_r d ON d.dataset_id = p.dataset_id)
WHERE position > 3""")

_LATEST = f"""
latest_r AS (
  SELECT * FROM (SELECT *, {_PPOS} AS rn FROM partitions_r) WHERE rn = 1)"""

SQL["partition_view"] = _q("""
SELECT p.*,
       coalesce(p.partition_id = l.partition_id, false) AS is_latest,
       CAST(hs.centi // 100 AS VARCHAR) ||
         CASE WHEN hs.centi % 100 = 0 THEN ''
              WHEN hs.centi % 10 = 0 THEN '.' || CAST((hs.centi % 100) // 10 AS VARCHAR)
              ELSE '.' || lpad(CAST(hs.centi % 100 AS VARCHAR), 2, '0') END ||
         (['B','KB','MB','GB','TB','PB'])[hs.k + 1] AS size_display,
       strftime(p.created_at, '%m/%d/%Y %H:%M:%S') || ' UTC' AS created_display
FROM partitions_r p
LEFT JOIN latest_r l ON l.dataset_id = p.dataset_id
JOIN (SELECT partition_id, k,
             CAST((CAST(partition_size AS HUGEINT) * 100 + (CAST(1 AS HUGEINT) << (10 * k)) // 2)
                  // (CAST(1 AS HUGEINT) << (10 * k)) AS BIGINT) AS centi
      FROM (SELECT partition_id, partition_size,
                   CASE WHEN partition_size >= 1125899906842624 THEN 5
                        WHEN partition_size >= 1099511627776 THEN 4
                        WHEN partition_size >= 1073741824 THEN 3
                        WHEN partition_size >= 1048576 THEN 2
                        WHEN partition_size >= 1024 THEN 1 ELSE 0 END AS k
            FROM partitions_r)) hs ON hs.partition_id = p.partition_id""", _LATEST)

SQL["find_datasets"] = _q(f"""
SELECT r.dataset_name, v.dataset_id, v.manager_id, v.manager_email, v.dataset_compression,
       v.dataset_format, v.dataset_classification, v.dataset_schema, v.dataset_desc, v.created_at, v.updated_at,
       v.dataset_id IS NOT NULL AS found
FROM (SELECT c_name AS dataset_name FROM customer UNION ALL SELECT n_name FROM nation) r
LEFT JOIN view_r v ON v.dataset_name = r.dataset_name""")

SQL["find_partitions"] = _q("""
SELECT r.dataset_name, r.partition_name, d.dataset_id,
       CASE WHEN r.partition_name = 'latest' THEN l.partition_name ELSE p.partition_name END
         AS resolved_name,
       coalesce(l.partition_id, p.partition_id) AS partition_id,
       coalesce(l.partition_url, p.partition_url) AS partition_url,
       coalesce(l.partition_size, p.partition_size) AS partition_size,
       coalesce(l.created_at, p.created_at) AS created_at,
       coalesce(l.updated_at, p.updated_at) AS updated_at,
       coalesce(l.partition_id, p.partition_id) IS NOT NULL AS found
FROM (SELECT c.c_name AS dataset_name,
             CASE WHEN o.o_orderkey % 10 = 0 THEN 'latest'
                  WHEN o.o_orderkey % 10 = 1 THEN 'missing-' || CAST(o.o_orderkey AS VARCHAR)
                  ELSE pr.partition_name END AS partition_name
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN partitions_r pr ON pr.partition_id = o.o_orderkey) r
LEFT JOIN datasets_r d ON d.dataset_name = r.dataset_name
LEFT JOIN partitions_r p ON r.partition_name <> 'latest' AND p.dataset_id = d.dataset_id
                        AND p.partition_name = r.partition_name
LEFT JOIN latest_r l ON r.partition_name = 'latest' AND l.dataset_id = d.dataset_id""", _LATEST)

_KEYS = """
keys_r AS (
  SELECT 'key-' || CAST(n_nationkey AS VARCHAR) AS api_key FROM nation
  UNION ALL SELECT 'key-' || CAST(n_nationkey + 100 AS VARCHAR) FROM nation)"""

SQL["find_managers"] = _q("""
SELECT k.api_key, m.manager_id, m.manager_email, m.manager_id IS NOT NULL AS found
FROM keys_r k LEFT JOIN managers_r m ON m.api_key = k.api_key""", _KEYS)

SQL["manager_public"] = _q("SELECT manager_id, manager_email, api_key FROM managers_r")

SQL["manager_datasets"] = _q("""
SELECT m.api_key, d.dataset_id, d.dataset_name, d.manager_id, '' AS manager_email,
       d.dataset_compression, d.dataset_format, d.dataset_classification, d.dataset_schema, d.dataset_desc,
       d.created_at, d.updated_at
FROM datasets_r d JOIN managers_r m ON m.manager_id = d.manager_id
WHERE m.api_key IN (SELECT api_key FROM keys_r)""", _KEYS)

SQL["partitions_by_name"] = _q("""
SELECT p.*, d.dataset_name FROM partitions_r p JOIN datasets_r d ON d.dataset_id = p.dataset_id
WHERE d.dataset_name IN (SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation)""")

_TERMS = r"""
terms_r AS (
  SELECT DISTINCT term, regexp_replace('%' || term || '%', '(\\[%_\\])|\\', '\1', 'g') AS pat FROM (
    SELECT '#00000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS term FROM nation
    UNION ALL SELECT '0001_' || CAST(n_nationkey AS VARCHAR) FROM nation
    UNION ALL SELECT 'r#%' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation
    UNION ALL SELECT '\' || n_name FROM nation
    UNION ALL SELECT '\_' || CAST(n_nationkey AS VARCHAR) FROM nation
    UNION ALL SELECT '0' || CAST(n_nationkey AS VARCHAR) || '\' FROM nation
    UNION ALL SELECT '%' || repeat('_', n_nationkey) FROM nation
    UNION ALL SELECT substr(CAST(n_nationkey AS VARCHAR), 1, 1) FROM nation))"""

_SEARCH = f"""
SELECT t.term, {', '.join('v.' + c.strip() for c in _VCOLS.split(','))}
FROM view_r v JOIN terms_r t ON v.dataset_name LIKE t.pat ESCAPE '\\'"""

SQL["search_datasets"] = _q(_SEARCH, _TERMS)
SQL["search_datasets_indexed"] = SQL["search_datasets"]

SQL["search_counts"] = _q(f"""
SELECT t.term, CAST(count(s.dataset_id) AS BIGINT) AS hits
FROM (SELECT DISTINCT term FROM terms_r) t LEFT JOIN ({_SEARCH}) s ON s.term = t.term
GROUP BY t.term""", _TERMS)

SQL["schema_fields"] = _q("""
SELECT d.dataset_id, d.dataset_name, f.field, f.field_type,
       row_number() OVER (PARTITION BY d.dataset_id ORDER BY length(f.field), f.field) AS position
FROM datasets_r d
JOIN (VALUES (1, 'station', 'string'), (2, 'reading', 'float'),
             (3, 'unit', 'string'), (4, 'taken_on', 'date'),
             (5, 'sensor_no', 'integer')) f(i, field, field_type) ON f.i <= d.n_fields""")

SQL["storage_uri"] = _q("""
SELECT dataset_id, dataset_name, dataset_classification,
       'org-datasets-' || dataset_classification AS bucket,
       'gs://org-datasets-' || dataset_classification || '/' || dataset_name || '/' AS storage_uri
FROM datasets_r""")

SQL["dataset_freshness"] = _q("""
SELECT d.dataset_id, d.dataset_name, d.dataset_desc, d.dataset_format, d.dataset_compression,
       d.dataset_classification, d.dataset_schema, d.manager_id, d.created_at,
       greatest(d.updated_at, (SELECT max(p.created_at) FROM partitions_r p
                               WHERE p.dataset_id = d.dataset_id)) AS updated_at
FROM datasets_r d""")

SQL["expected_ext"] = _q(f"""
SELECT dataset_id, dataset_format, dataset_compression,
       concat_ws('.', ({_FORMAT_EXT})[list_position({_FORMATS}, dataset_format)],
                 nullif(({_COMPRESSION_EXT})[list_position({_COMPRESSIONS}, dataset_compression)], ''))
         AS expected_ext
FROM datasets_r""")

# Bucket notifications ----------------------------------------------------

_EVENTS = r"""
ev_r AS (
  SELECT event_id, ts, user_id, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'purchase' THEN 'OBJECT_FINALIZE' WHEN 'signup' THEN 'OBJECT_FINALIZE'
                         WHEN 'view' THEN 'OBJECT_METADATA_UPDATE' WHEN 'click' THEN 'OBJECT_ARCHIVE'
                         WHEN 'error' THEN 'OBJECT_DELETE' END AS etype,
         'user_' || CAST(user_id AS VARCHAR) AS ds
  FROM events),
obj_r AS (
  SELECT *,
         CASE WHEN event_id % 211 = 0 THEN ds || '/dd.json'
              WHEN event_id % 97 = 0 THEN ds || '/latest'
              WHEN event_id % 193 = 0 THEN ds || '/' || ds || '/' || CAST(k AS VARCHAR)
              ELSE ds || '/2024/' || CAST(k % 10 AS VARCHAR) || '.ndjson' END AS object_id,
         CASE WHEN etype = 'OBJECT_DELETE' AND event_id % 5 = 0
              THEN CAST(event_id + 1 AS VARCHAR) END AS overwritten_by_generation
  FROM ev_r),
decoded_r AS (
  SELECT 'ack-' || CAST(event_id AS VARCHAR) AS ack_id,
         CAST(event_id AS VARCHAR) AS message_id,
         ts + INTERVAL 1 SECOND AS publish_time,
         etype AS event_type, ts AS event_time, overwritten_by_generation,
         CASE WHEN event_id % 89 <> 0 THEN object_id END AS object_name,
         CASE WHEN event_id % 89 <> 0
              THEN 'https://storage.example.com/b/org-datasets-events/o/' || object_id END AS self_link,
         CASE WHEN event_id % 89 <> 0 AND event_id % 101 <> 0
              THEN CAST(round(value * 100) AS BIGINT) END AS size,
         CASE WHEN event_id % 89 <> 0 THEN ds END AS dataset_name,
         CASE WHEN event_id % 89 <> 0 THEN
           CASE WHEN rest = ds OR rest = 'dd.json' THEN NULL ELSE rest END END AS partition_name,
         CASE WHEN event_id % 89 = 0 THEN 'undecodable payload'
              WHEN event_id % 101 = 0 THEN 'size is not an integer' END AS reason
  FROM (SELECT *, regexp_replace(object_id, '^(?:' || regexp_escape(ds || '/') || ')+', '') AS rest
        FROM obj_r)),
edatasets_r AS (
  SELECT CAST(user_id AS BIGINT) AS dataset_id, 'user_' || CAST(user_id AS VARCHAR) AS dataset_name,
         """ + _schema("user_id") + r""" AS dataset_schema,
         'events of user ' || CAST(user_id AS VARCHAR) AS dataset_desc,
         (['plaintext','json','ndjson','csv','tsv','protobuf'])[user_id % 6 + 1] AS dataset_format,
         (['uncompressed','zip','gzip'])[user_id % 3 + 1] AS dataset_compression,
         (['confidential','internal','public','restricted'])[user_id % 4 + 1] AS dataset_classification,
         CAST(user_id % 25 AS BIGINT) AS manager_id,
         TIMESTAMP '2023-12-01 00:00:00' + user_id * INTERVAL 1 MINUTE AS created_at,
         TIMESTAMP '2023-12-01 00:00:00' + user_id * INTERVAL 1 MINUTE AS updated_at
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 10 <> 0),
eparts_r AS (
  SELECT CAST(user_id * 16 + slot AS BIGINT) AS partition_id,
         '2024/' || CAST(slot AS VARCHAR) || '.ndjson' AS partition_name,
         'https://storage.example.com/b/org-datasets-events/o/user_' || CAST(user_id AS VARCHAR) ||
           '/2024/' || CAST(slot AS VARCHAR) || '.ndjson' AS partition_url,
         CAST(slot + 1000 AS BIGINT) AS partition_size,
         CAST(user_id AS BIGINT) AS dataset_id,
         TIMESTAMP '2023-12-15 00:00:00' + (user_id * 60 + slot) * INTERVAL 1 SECOND AS created_at,
         TIMESTAMP '2023-12-15 00:00:00' + (user_id * 60 + slot) * INTERVAL 1 SECOND AS updated_at
  FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS slot
        FROM events)
  WHERE slot < 3 AND user_id % 10 <> 0),
routed_r AS (
  SELECT d.*, e.dataset_id,
         CASE
           WHEN d.reason IS NOT NULL THEN 'dead_letter'
           WHEN e.dataset_id IS NOT NULL AND d.event_type IN
                ('OBJECT_FINALIZE', 'OBJECT_METADATA_UPDATE', 'OBJECT_ARCHIVE') THEN
             CASE WHEN d.partition_name IS NULL THEN 'noop'
                  WHEN d.partition_name = 'latest' OR length(d.partition_name) > 255
                       OR length(d.self_link) > 255 THEN 'reject'
                  ELSE 'upsert' END
           WHEN e.dataset_id IS NOT NULL AND d.event_type = 'OBJECT_DELETE' THEN
             CASE WHEN d.overwritten_by_generation IS NOT NULL THEN 'skip'
                  WHEN d.partition_name IS NOT NULL THEN 'delete_partition'
                  ELSE 'delete_dataset' END
           WHEN ends_with(d.object_name, 'dd.json') OR d.partition_name IS NULL THEN 'ignore'
           ELSE 'retry' END AS action
  FROM decoded_r d LEFT JOIN edatasets_r e ON e.dataset_name = d.dataset_name)"""

# Sequential reading of the fold: one global sequence number, windows per
# key (lag), the dataset deletion as "any earlier delete_dataset".
_FOLD = r"""
seq_r AS (
  SELECT *, row_number() OVER (ORDER BY event_time, publish_time, message_id) AS seq FROM routed_r),
gone_r AS (
  SELECT dataset_id, min(seq) AS gone_seq FROM seq_r WHERE action = 'delete_dataset' GROUP BY dataset_id),
eff_r AS (
  SELECT s.*, g.gone_seq,
         CASE WHEN g.gone_seq IS NOT NULL AND s.seq > g.gone_seq AND s.action <> 'dead_letter' THEN
                CASE WHEN ends_with(s.object_name, 'dd.json') OR s.partition_name IS NULL
                     THEN 'ignore' ELSE 'retry' END
              ELSE s.action END AS eff
  FROM seq_r s LEFT JOIN gone_r g ON g.dataset_id = s.dataset_id),
key_r AS (
  SELECT e.*,
         lag(eff) OVER (PARTITION BY e.dataset_id, e.partition_name ORDER BY seq) AS prev,
         max(CASE WHEN eff = 'delete_partition' THEN seq END)
           OVER (PARTITION BY e.dataset_id, e.partition_name) AS ld,
         p.partition_id IS NOT NULL AS had
  FROM eff_r e LEFT JOIN eparts_r p
    ON p.dataset_id = e.dataset_id AND p.partition_name = e.partition_name
  WHERE eff IN ('upsert', 'delete_partition')),
ins_r AS (
  SELECT dataset_id, max(event_time) AS fresh FROM key_r
  WHERE eff = 'upsert' AND (prev = 'delete_partition' OR (prev IS NULL AND NOT had))
  GROUP BY dataset_id),
surv_r AS (
  SELECT dataset_id, partition_name, any_value(had) AS had, any_value(ld) AS ld,
         min(event_time) AS first_time,
         arg_max(self_link, seq) AS url, arg_max(size, seq) AS sz, max(event_time) AS last_time
  FROM key_r WHERE eff = 'upsert' AND (ld IS NULL OR seq > ld)
  GROUP BY dataset_id, partition_name),
deleted_r AS (SELECT dataset_id FROM gone_r),
touched_r AS (SELECT DISTINCT dataset_id, partition_name FROM key_r),
newp_r AS (
  SELECT s.dataset_id, s.partition_name, s.url, s.sz, s.first_time AS created_at, s.last_time
  FROM surv_r s WHERE NOT (s.had AND s.ld IS NULL)
    AND s.dataset_id NOT IN (SELECT dataset_id FROM deleted_r)),
fold_parts_r AS (
  SELECT p.* FROM eparts_r p
  WHERE NOT EXISTS (SELECT 1 FROM touched_r t WHERE t.dataset_id = p.dataset_id
                                             AND t.partition_name = p.partition_name)
    AND p.dataset_id NOT IN (SELECT dataset_id FROM deleted_r)
  UNION ALL
  SELECT p.partition_id, p.partition_name, s.url, s.sz, p.dataset_id, p.created_at,
         greatest(p.updated_at, s.last_time)
  FROM surv_r s JOIN eparts_r p ON p.dataset_id = s.dataset_id AND p.partition_name = s.partition_name
  WHERE s.had AND s.ld IS NULL AND s.dataset_id NOT IN (SELECT dataset_id FROM deleted_r)
  UNION ALL
  SELECT (SELECT coalesce(max(partition_id), 0) FROM eparts_r)
           + row_number() OVER (ORDER BY created_at, dataset_id, partition_name),
         partition_name, url, sz, dataset_id, created_at, last_time
  FROM newp_r)"""

SQL["flatten_envelope"] = "WITH " + _EVENTS.strip() + """
SELECT 'ack-' || CAST(event_id AS VARCHAR) AS ack_id, CAST(event_id AS VARCHAR) AS message_id,
       ts + INTERVAL 1 SECOND AS publish_time, etype AS event_type, ts AS event_time,
       object_id, overwritten_by_generation,
       CASE WHEN event_id % 89 = 0 THEN '@@not-base64@@' ELSE base64(encode(payload)) END AS data
FROM (SELECT *, '{"kind":"storage#object","id":"org-datasets-events/' || object_id || '/' || event_id ||
        '","selfLink":"https://storage.example.com/b/org-datasets-events/o/' || object_id ||
        '","name":"' || object_id || '","bucket":"org-datasets-events","generation":"' || event_id ||
        '","metageneration":"1","contentType":"application/x-ndjson","timeCreated":"' || t ||
        '","updated":"' || t || '","storageClass":"STANDARD","timeStorageClassUpdated":"' || t ||
        '","size":"' || CASE WHEN event_id % 101 = 0 THEN 'n/a'
                             ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END || '"}' AS payload
      FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS t FROM obj_r))"""

SQL["decode_notifications"] = "WITH " + _EVENTS.strip() + """
SELECT message_id, object_name, self_link, size, dataset_name, partition_name, reason FROM decoded_r"""

SQL["decode_envelopes"] = SQL["decode_notifications"]

SQL["parse_paths"] = "WITH " + _EVENTS.strip() + r"""
SELECT CAST(event_id AS VARCHAR) AS message_id, object_id, ds AS dataset_name,
       CASE WHEN rest = ds OR rest = 'dd.json' THEN NULL ELSE rest END AS partition_name
FROM (SELECT *, regexp_replace(object_id, '^(?:' || regexp_escape(ds || '/') || ')+', '') AS rest
      FROM obj_r)"""

SQL["dead_letters"] = "WITH " + _EVENTS.strip() + """
SELECT ack_id, message_id, event_time, object_name, reason FROM decoded_r WHERE reason IS NOT NULL"""

SQL["route_events"] = "WITH " + _EVENTS.strip() + """
SELECT message_id, dataset_name, partition_name, dataset_id, action, action <> 'retry' AS acked
FROM routed_r"""

SQL["fold_partitions"] = "WITH " + _EVENTS.strip() + "," + _FOLD.strip() + """
SELECT * FROM fold_parts_r"""

SQL["fold_datasets"] = "WITH " + _EVENTS.strip() + "," + _FOLD.strip() + """
SELECT d.dataset_id, d.dataset_name, d.dataset_desc, d.dataset_format, d.dataset_compression,
       d.dataset_classification, d.dataset_schema, d.manager_id, d.created_at,
       greatest(d.updated_at, i.fresh) AS updated_at
FROM edatasets_r d LEFT JOIN ins_r i ON i.dataset_id = d.dataset_id
WHERE d.dataset_id NOT IN (SELECT dataset_id FROM deleted_r)"""

SQL["pending_events"] = "WITH " + _EVENTS.strip() + "," + _FOLD.strip() + """
SELECT message_id, dataset_name, partition_name, eff AS action FROM eff_r WHERE eff = 'retry'"""

# Mutations ---------------------------------------------------------------

_NOW = "TIMESTAMP '2025-01-01 00:00:00'"

_CONFIGS = f"""
cfg_r AS (
  SELECT s_suppkey AS request_id, CAST(s_nationkey AS BIGINT) AS manager_id,
         CASE WHEN s_suppkey % 7 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
              ELSE 'supplier_ds_' || CAST(s_suppkey // 2 AS VARCHAR) END AS name,
         (CASE WHEN s_suppkey % 11 = 0 THEN 'Parquet'
                         WHEN s_suppkey % 13 = 0 THEN upper(({_FORMATS})[s_suppkey % 6 + 1])
                         ELSE ({_FORMATS})[s_suppkey % 6 + 1] END) AS format,
         ({_COMPRESSIONS})[s_suppkey % 3 + 1] AS compression,
         ({_CLASSES})[s_nationkey % 4 + 1] AS classification,
         'supplied by ' || s_name AS description
  FROM supplier),
chk_r AS (
  SELECT c.*,
         CASE WHEN name IS NULL OR description IS NULL THEN 'missing field'
              WHEN length(name) > 255 THEN 'name too long'
              WHEN format IS NULL OR format NOT IN (SELECT unnest({_FORMATS})) THEN 'unknown format'
              WHEN compression IS NULL OR compression NOT IN (SELECT unnest({_COMPRESSIONS}))
                THEN 'unknown compression'
              WHEN classification IS NULL OR classification NOT IN (SELECT unnest({_CLASSES}))
                THEN 'unknown classification'
              WHEN manager_id NOT IN (SELECT manager_id FROM managers_r) THEN 'unknown manager'
         END AS invalid
  FROM cfg_r c),
dec_r AS (
  SELECT *,
         CASE WHEN invalid IS NOT NULL THEN invalid
              WHEN name IN (SELECT dataset_name FROM datasets_r) THEN 'dataset_name already registered'
              WHEN request_id <> min(CASE WHEN invalid IS NULL THEN request_id END)
                                   OVER (PARTITION BY name) THEN 'duplicate dataset_name in batch'
         END AS reason
  FROM chk_r)"""

SQL["register_datasets"] = _q(f"""
SELECT (SELECT max(dataset_id) FROM datasets_r) + row_number() OVER (ORDER BY request_id) AS dataset_id,
       name AS dataset_name, description AS dataset_desc, format AS dataset_format,
       compression AS dataset_compression, classification AS dataset_classification,
       {_schema("request_id")} AS dataset_schema, manager_id, {_NOW} AS created_at, {_NOW} AS updated_at
FROM dec_r WHERE reason IS NULL""", _CONFIGS)

SQL["register_rejected"] = _q("""
SELECT request_id, name, reason FROM dec_r WHERE reason IS NOT NULL""", _CONFIGS)

_SIGNUPS = """
sign_r AS (
  SELECT s_suppkey AS request_id,
         'mgr' || CAST(s_suppkey // 3 AS VARCHAR) ||
           CASE WHEN s_suppkey % 9 = 4 THEN '@other.org' ELSE '@registry.test' END AS manager_email
  FROM supplier),
sdec_r AS (
  SELECT *,
         CASE WHEN invalid IS NOT NULL THEN invalid
              WHEN manager_email IN (SELECT manager_email FROM managers_r)
                THEN 'manager_email already registered'
              WHEN request_id <> min(CASE WHEN invalid IS NULL THEN request_id END)
                                   OVER (PARTITION BY manager_email)
                THEN 'duplicate manager_email in batch' END AS reason
  FROM (SELECT *,
               CASE WHEN manager_email IS NULL THEN 'missing field'
                    WHEN length(manager_email) > 64 THEN 'email too long'
                    WHEN NOT contains(manager_email, '@registry.test')
                      THEN 'email outside the domain' END AS invalid
        FROM sign_r))"""

SQL["register_managers"] = _q(f"""
SELECT * FROM managers_r
UNION ALL
SELECT (SELECT max(manager_id) FROM managers_r) + row_number() OVER (ORDER BY request_id),
       manager_email,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
         substr(h, 17, 4) || '-' || substr(h, 21, 12),
       false, {_NOW}, {_NOW}
FROM (SELECT *, sha256('test secret' || ':' || manager_email || ':' || CAST(request_id AS VARCHAR)) AS h FROM sdec_r)
WHERE reason IS NULL""", _SIGNUPS)

SQL["register_managers_rejected"] = _q("""
SELECT request_id, manager_email, reason FROM sdec_r WHERE reason IS NOT NULL""", _SIGNUPS)

_UPSERTS = """
rows_r AS (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS request_id, p.dataset_id,
         CASE WHEN l.l_linenumber = 1 THEN p.partition_name
              WHEN l.l_linenumber = 7 THEN 'latest'
              ELSE 'line-' || CAST(l.l_orderkey AS VARCHAR) || '-' ||
                   CAST(CASE WHEN l.l_linenumber = 3 THEN 2 ELSE l.l_linenumber END AS VARCHAR)
         END AS partition_name,
         'lake://lines/' || CAST(l.l_orderkey AS VARCHAR) || '/' || CAST(l.l_linenumber AS VARCHAR)
           AS partition_url,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS partition_size
  FROM lineitem l JOIN partitions_r p ON p.partition_id = l.l_orderkey),
last_r AS (
  SELECT dataset_id, partition_name, partition_url AS url, partition_size AS sz FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, partition_name
                                 ORDER BY request_id DESC, partition_url DESC, partition_size DESC) AS rn
    FROM rows_r
    WHERE dataset_id IN (SELECT dataset_id FROM datasets_r) AND partition_name <> 'latest'
      AND length(partition_name) <= 255 AND length(partition_url) <= 255)
  WHERE rn = 1),
ins_keys_r AS (
  SELECT l.* FROM last_r l
  WHERE NOT EXISTS (SELECT 1 FROM partitions_r p WHERE p.dataset_id = l.dataset_id
                                                  AND p.partition_name = l.partition_name))"""

SQL["upsert_partitions"] = _q(f"""
SELECT p.* FROM partitions_r p
WHERE NOT EXISTS (SELECT 1 FROM last_r l WHERE l.dataset_id = p.dataset_id
                                          AND l.partition_name = p.partition_name)
UNION ALL
SELECT p.partition_id, p.partition_name, l.url, l.sz, p.dataset_id, p.created_at, {_NOW}
FROM partitions_r p JOIN last_r l ON l.dataset_id = p.dataset_id AND l.partition_name = p.partition_name
UNION ALL
SELECT (SELECT max(partition_id) FROM partitions_r)
         + row_number() OVER (ORDER BY dataset_id, partition_name),
       partition_name, url, sz, dataset_id, {_NOW}, {_NOW}
FROM ins_keys_r""", _UPSERTS)

SQL["upsert_datasets"] = _q(f"""
SELECT dataset_id, dataset_name, dataset_desc, dataset_format, dataset_compression,
       dataset_classification, dataset_schema, manager_id, created_at,
       CASE WHEN dataset_id IN (SELECT dataset_id FROM ins_keys_r) THEN greatest(updated_at, {_NOW})
            ELSE updated_at END AS updated_at
FROM datasets_r""", _UPSERTS)

SQL["upsert_rejected"] = _q("""
SELECT request_id, dataset_id, nm AS partition_name,
       CASE WHEN nm IS NULL OR request_id % 10 = 0 OR request_id % 11 = 0 THEN 'missing field'
            ELSE 'reserved partition name' END AS reason
FROM (SELECT *, CASE WHEN request_id % 9 <> 0 THEN partition_name END AS nm FROM rows_r)
WHERE nm IS NULL OR nm = 'latest' OR request_id % 10 = 0 OR request_id % 11 = 0""", _UPSERTS)

SQL["committed_upsert"] = SQL["upsert_partitions"]
SQL["committed_managers"] = SQL["register_managers"]
SQL["committed_datasets"] = SQL["register_datasets"]

SQL["committed_deletes"] = _q("""
SELECT p.* FROM partitions_r p
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_orderkey = p.partition_id)
  AND p.dataset_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')""")

SQL["deep_pages"] = _q(f"""
SELECT * FROM (
  SELECT p.*, d.dataset_name, {_PPOS_P} AS position
  FROM partitions_r p JOIN datasets_r d ON d.dataset_id = p.dataset_id)
WHERE position > 1 AND position <= 2001""")

SQL["delete_partitions"] = _q("""
SELECT p.* FROM partitions_r p
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_orderkey = p.partition_id)""")

SQL["delete_datasets"] = _q("""
SELECT p.* FROM partitions_r p
WHERE p.dataset_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')""")

SQL["generate_datasets"] = f"""
SELECT c_custkey + 1 AS request_id,
       'station_readings_' || CAST(c_custkey + 1 AS VARCHAR) || '_' ||
         replace(replace(replace(replace(strftime({_NOW}, '%Y-%m-%d %H:%M:%S.%f UTC'),
                                         ':', ''), '-', ''), '.', '_'), ' ', '_') AS name,
       'internal' AS classification, 'gzip' AS compression, 'ndjson' AS format,
       'Hourly readings of all stations' AS description,
       'hour:timestamp,mean_reading:float,station:string' AS schema
FROM customer"""

# Constraint reports over a registry loaded without constraints ---------------

_DIRTY = f"""
dmanagers AS (SELECT * FROM managers_r),
ddatasets AS (
  SELECT CAST(p_partkey AS BIGINT) AS dataset_id, p_name AS dataset_name,
         nullif(p_brand, 'Brand#13') AS dataset_desc,
         lower(p_type) AS dataset_format, ({_COMPRESSIONS})[p_size % 3 + 1] AS dataset_compression,
         ({_CLASSES})[p_partkey % 4 + 1] AS dataset_classification,
         'x' AS dataset_schema, CAST(p_size AS BIGINT) AS manager_id,
         TIMESTAMP '1994-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS created_at,
         TIMESTAMP '1994-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS updated_at
  FROM part),
dpartitions AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS partition_id,
         'line-' || CAST(l_linenumber AS VARCHAR) AS partition_name,
         'lake://lines/' || repeat('x', CAST(l_quantity * 6 AS INTEGER)) AS partition_url,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS partition_size,
         CAST(l_partkey AS BIGINT) AS dataset_id, l_shipdate AS created_at, l_shipdate AS updated_at
  FROM lineitem)"""


def _report_sql() -> str:
    from .. import schemas as S
    from ..operators.quality import DOMAIN, LENGTH, UNIQUE
    parts = []
    for table, schema in S.TABLES.items():
        src = "d" + table
        for f in schema.fields:
            if not f.nullable:
                parts.append(f"SELECT '{table}.{f.name} not null' AS rule, "
                             f"sum(CASE WHEN {f.name} IS NULL THEN 1 ELSE 0 END) AS violations FROM {src}")
        for c, n in LENGTH.get(table, {}).items():
            parts.append(f"SELECT '{table}.{c} length <= {n}', "
                         f"sum(CASE WHEN length({c}) > {n} THEN 1 ELSE 0 END) FROM {src}")
        if table == "datasets":
            for c, dom in DOMAIN.items():
                lst = ", ".join(f"'{v}'" for v in dom)
                parts.append(f"SELECT 'datasets.{c} in domain', "
                             f"sum(CASE WHEN {c} NOT IN ({lst}) THEN 1 ELSE 0 END) FROM {src}")
        for cols in UNIQUE[table]:
            cl = ", ".join(cols)
            parts.append(f"SELECT '{table} unique({cl})', count(*) FROM "
                         f"(SELECT {cl} FROM {src} GROUP BY {cl} HAVING count(*) > 1)")
    parts.append("SELECT 'foreign key datasets.manager_id', count(*) FROM ddatasets d WHERE NOT EXISTS "
                 "(SELECT 1 FROM dmanagers m WHERE m.manager_id = d.manager_id)")
    parts.append("SELECT 'foreign key partitions.dataset_id', count(*) FROM dpartitions p WHERE NOT EXISTS "
                 "(SELECT 1 FROM ddatasets d WHERE d.dataset_id = p.dataset_id)")
    body = "\nUNION ALL ".join(parts)
    return _q(f"SELECT rule, CAST(coalesce(violations, 0) AS BIGINT) AS violations FROM ({body})", _DIRTY)


SQL["orphans"] = _q("""
SELECT 'datasets.manager_id' AS rule, CAST(dataset_id AS VARCHAR) AS key,
       'no manager ' || CAST(manager_id AS VARCHAR) AS reason
FROM ddatasets WHERE manager_id NOT IN (SELECT manager_id FROM dmanagers)
UNION ALL
SELECT 'partitions.dataset_id', CAST(partition_id AS VARCHAR), 'no dataset ' || CAST(dataset_id AS VARCHAR)
FROM dpartitions WHERE dataset_id NOT IN (SELECT dataset_id FROM ddatasets)""", _DIRTY)

SQL["constraint_report"] = _report_sql()

SQL["unique_violations"] = _q("""
SELECT 'managers unique(manager_email)' AS rule, manager_email AS key, CAST(count(*) AS VARCHAR) || ' rows' AS reason
FROM dmanagers GROUP BY manager_email HAVING count(*) > 1
UNION ALL
SELECT 'managers unique(api_key)', api_key, CAST(count(*) AS VARCHAR) || ' rows'
FROM dmanagers GROUP BY api_key HAVING count(*) > 1
UNION ALL
SELECT 'datasets unique(dataset_name)', dataset_name, CAST(count(*) AS VARCHAR) || ' rows'
FROM ddatasets GROUP BY dataset_name HAVING count(*) > 1
UNION ALL
SELECT 'partitions unique(dataset_id, partition_name)',
       CAST(dataset_id AS VARCHAR) || '/' || partition_name, CAST(count(*) AS VARCHAR) || ' rows'
FROM dpartitions GROUP BY dataset_id, partition_name HAVING count(*) > 1""", _DIRTY)

# Scans, config files, attributes, per-rule listings ---------------------------

SQL["scan_datasets"] = _q("""
SELECT dataset_id, dataset_name, dataset_desc, dataset_format, dataset_compression,
       dataset_classification, dataset_schema, manager_id, created_at, updated_at FROM datasets_r""")

SQL["scan_partitions"] = _q("SELECT * FROM partitions_r")

SQL["config_roundtrip"] = _q("""
SELECT dataset_name AS name, dataset_classification AS classification,
       dataset_compression AS compression, dataset_format AS format, dataset_desc AS description,
       dataset_schema AS schema FROM datasets_r""")

SQL["attribute_variants"] = _q(f"""
SELECT d.kind, string_agg(d.value, ',' ORDER BY d.ord) AS variants,
       string_agg(CAST(d.n AS VARCHAR), ',' ORDER BY d.ord) AS datasets
FROM (SELECT d.kind, d.ord, d.value, count(x.v) AS n
      FROM (SELECT 'format' AS kind, i - 1 AS ord, ({_FORMATS})[i] AS value FROM range(1, 7) t(i)
            UNION ALL SELECT 'compression', i - 1, ({_COMPRESSIONS})[i] FROM range(1, 4) t(i)
            UNION ALL SELECT 'classification', i - 1, ({_CLASSES})[i] FROM range(1, 5) t(i)) d
      LEFT JOIN (SELECT 'format' AS kind, dataset_format AS v FROM datasets_r
                 UNION ALL SELECT 'compression', dataset_compression FROM datasets_r
                 UNION ALL SELECT 'classification', dataset_classification FROM datasets_r) x
        ON x.kind = d.kind AND x.v = d.value
      GROUP BY d.kind, d.ord, d.value) d
GROUP BY d.kind""")

SQL["find_managers_by_email"] = _q("""
SELECT r.manager_email, m.manager_id, m.api_key, m.manager_id IS NOT NULL AS found
FROM (SELECT lower(n_name) || '@example.com' AS manager_email FROM nation
      UNION ALL SELECT lower(n_name) || '@elsewhere.org' FROM nation) r
LEFT JOIN managers_r m ON m.manager_email = r.manager_email""")


def _row_rules_sql(kind: str) -> str:
    from .. import schemas as S
    from ..operators.quality import DOMAIN, LENGTH
    ids = {"managers": "manager_id", "datasets": "dataset_id", "partitions": "partition_id"}
    parts = []
    for table, schema in S.TABLES.items():
        src, key = "d" + table, ids[table]
        rules = []
        if kind == "not null":
            rules = [(f"{table}.{f.name} not null", f"{f.name} IS NULL") for f in schema.fields
                     if not f.nullable]
        elif kind == "length":
            rules = [(f"{table}.{c} length <= {n}", f"length({c}) > {n}")
                     for c, n in LENGTH.get(table, {}).items()]
        elif kind == "in domain" and table == "datasets":
            rules = [(f"datasets.{c} in domain", f"{c} NOT IN ({', '.join(repr(v) for v in dom)})")
                     for c, dom in DOMAIN.items()]
        for rule, cond in rules:
            parts.append(f"SELECT '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, 'violated' AS reason "
                         f"FROM {src} WHERE coalesce({cond}, false)")
    return _q("\nUNION ALL ".join(parts), _DIRTY)


SQL["null_violations"] = _row_rules_sql("not null")
SQL["length_violations"] = _row_rules_sql("length")
SQL["domain_violations"] = _row_rules_sql("in domain")

# The stored registry -------------------------------------------------------

SQL["stored_stream"] = "WITH " + _EVENTS.strip() + "," + _FOLD.strip() + """
SELECT partition_name, partition_url, partition_size, dataset_id, created_at, updated_at FROM fold_parts_r"""

SQL["stored_dead_letters"] = SQL["dead_letters"]

SQL["stored_pending"] = "WITH " + _EVENTS.strip() + "," + _FOLD.strip() + """
SELECT message_id, dataset_name, partition_name FROM eff_r
WHERE eff = 'retry' AND right(dataset_name, 2) NOT IN ('00', '20', '40', '60', '80')"""

SQL["stored_find_partitions"] = SQL["find_partitions"]
SQL["stored_search"] = SQL["search_datasets"]

SQL["stored_latest"] = _q(f"""
SELECT partition_id, partition_name, partition_url, partition_size, dataset_id, created_at, updated_at
FROM (SELECT u.*, {_PPOS} AS rn FROM upserted_r u
      WHERE dataset_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
        AND NOT EXISTS (SELECT 1 FROM partitions_r p JOIN orders o ON o.o_orderkey = p.partition_id
                        WHERE o.o_orderstatus = 'F' AND p.dataset_id = u.dataset_id
                          AND p.partition_name = u.partition_name))
WHERE rn = 1""", _UPSERTS, f"""
upserted_r AS (
  SELECT p.* FROM partitions_r p
  WHERE NOT EXISTS (SELECT 1 FROM last_r l WHERE l.dataset_id = p.dataset_id AND l.partition_name = p.partition_name)
  UNION ALL
  SELECT p.partition_id, p.partition_name, l.url, l.sz, p.dataset_id, p.created_at, {_NOW}
  FROM partitions_r p JOIN last_r l ON l.dataset_id = p.dataset_id AND l.partition_name = p.partition_name
  UNION ALL
  SELECT (SELECT max(partition_id) FROM partitions_r) + row_number() OVER (ORDER BY dataset_id, partition_name),
         partition_name, url, sz, dataset_id, {_NOW}, {_NOW}
  FROM ins_keys_r)""")

SQL["stored_page"] = _q(f"""
SELECT * FROM (SELECT {_VCOLS}, {_POS} AS position FROM view_r)
WHERE position > 60 AND position <= 100""")

SQL["commit_report"] = _q("""
SELECT 'partitions.partition_name length <= 255' AS rule, CAST(r + 10000000 AS VARCHAR) AS key, 'violated' AS reason
FROM asked_r WHERE r % 7 = 0
UNION ALL
SELECT 'partitions.dataset_id', CAST(r + 10000000 AS VARCHAR), 'no dataset ' || CAST(dataset_id + 100000000 AS VARCHAR)
FROM asked_r WHERE r % 7 = 1""", _UPSERTS, """
asked_r AS (SELECT dataset_id, partition_name, max(request_id) AS r FROM rows_r
            WHERE dataset_id IS NOT NULL AND partition_name IS NOT NULL GROUP BY dataset_id, partition_name)""")
