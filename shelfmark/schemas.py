"""Registry table schemas, enum domains and other fixed values.

Everything a registry table looks like is declared here once, so readers
never infer a schema and every operator agrees on column names and types.
Ids are 64-bit: a registry that follows a 100 TB lake can pass 2^31 rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's values for equal results.
# ---------------------------------------------------------------------------

# Enum domains in declaration order (the order is part of the output of
# attribute_variants).
FORMATS = ["plaintext", "json", "ndjson", "csv", "tsv", "protobuf"]
COMPRESSIONS = ["uncompressed", "zip", "gzip"]
CLASSIFICATIONS = ["confidential", "internal", "public", "restricted"]

# File extension of each format and compression; an uncompressed file has
# no compression extension.
FORMAT_EXT = {
    "plaintext": "txt",
    "json": "json",
    "ndjson": "ndjson",
    "csv": "csv",
    "tsv": "tsv",
    "protobuf": "pb",
}
COMPRESSION_EXT = {"uncompressed": "", "zip": "zip", "gzip": "tar.gz"}

# Bucket notification event types and payload formats.
EVENT_FINALIZE = "OBJECT_FINALIZE"
EVENT_METADATA_UPDATE = "OBJECT_METADATA_UPDATE"
EVENT_DELETE = "OBJECT_DELETE"
EVENT_ARCHIVE = "OBJECT_ARCHIVE"
EVENT_TYPES = [EVENT_FINALIZE, EVENT_METADATA_UPDATE, EVENT_DELETE, EVENT_ARCHIVE]
PAYLOAD_FORMATS = ["JSON_API_V1", "NONE"]

# Reserved partition name that means "the newest partition".
LATEST = "latest"
# Object name of a dataset's config file.
CONFIG_FILE = "dd.json"

# Column length caps of the registry.
MAX_EMAIL = 64
MAX_NAME = 255
MAX_URL = 255

# Size units of the human-readable size, powers of 1024.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

# Default page size of the dataset listing.
DEFAULT_PAGE_COUNT = 10

# ---------------------------------------------------------------------------
# Registry tables
# ---------------------------------------------------------------------------

TS = T.TimestampNTZType()

MANAGERS = T.StructType(
    [
        T.StructField("manager_id", T.LongType(), False),
        T.StructField("manager_email", T.StringType(), False),
        T.StructField("api_key", T.StringType(), False),
        T.StructField("is_admin", T.BooleanType(), False),
        T.StructField("created_at", TS, False),
        T.StructField("updated_at", TS, False),
    ]
)

SCHEMA_MAP = T.MapType(T.StringType(), T.StringType(), valueContainsNull=True)

DATASETS = T.StructType(
    [
        T.StructField("dataset_id", T.LongType(), False),
        T.StructField("dataset_name", T.StringType(), False),
        T.StructField("dataset_desc", T.StringType(), False),
        T.StructField("dataset_format", T.StringType(), False),
        T.StructField("dataset_compression", T.StringType(), False),
        T.StructField("dataset_classification", T.StringType(), False),
        T.StructField("dataset_schema", SCHEMA_MAP, False),
        T.StructField("manager_id", T.LongType(), False),
        T.StructField("created_at", TS, False),
        T.StructField("updated_at", TS, False),
    ]
)

PARTITIONS = T.StructType(
    [
        T.StructField("partition_id", T.LongType(), False),
        T.StructField("partition_name", T.StringType(), False),
        T.StructField("partition_url", T.StringType(), False),
        T.StructField("partition_size", T.LongType(), False),
        T.StructField("dataset_id", T.LongType(), False),
        T.StructField("created_at", TS, False),
        T.StructField("updated_at", TS, False),
    ]
)

TABLES = {"managers": MANAGERS, "datasets": DATASETS, "partitions": PARTITIONS}

# Columns of the dataset view (datasets joined to their manager).
DATASET_VIEW_COLUMNS = [
    "dataset_id",
    "dataset_name",
    "manager_id",
    "manager_email",
    "dataset_compression",
    "dataset_format",
    "dataset_classification",
    "dataset_schema",
    "dataset_desc",
    "created_at",
    "updated_at",
]

PARTITION_COLUMNS = [f.name for f in PARTITIONS.fields]

# ---------------------------------------------------------------------------
# dd.json dataset config
# ---------------------------------------------------------------------------

DATASET_CONFIG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("schema", SCHEMA_MAP),
    ]
)

# ---------------------------------------------------------------------------
# Bucket notification (pull response envelope and JSON payload)
# ---------------------------------------------------------------------------

ATTRIBUTES = T.StructType(
    [
        T.StructField("notificationConfig", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("eventTime", T.TimestampType()),
        T.StructField("payloadFormat", T.StringType()),
        T.StructField("bucketId", T.StringType()),
        T.StructField("objectId", T.StringType()),
        T.StructField("objectGeneration", T.StringType()),
        T.StructField("overwrittenByGeneration", T.StringType()),
        T.StructField("overwroteGeneration", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("ackId", T.StringType()),
        T.StructField(
            "message",
            T.StructType(
                [
                    T.StructField("data", T.StringType()),
                    T.StructField("attributes", ATTRIBUTES),
                    T.StructField("messageId", T.StringType()),
                    T.StructField("publishTime", T.TimestampType()),
                ]
            ),
        ),
    ]
)

# Text of a pull response that is no JSON of this shape.
UNREADABLE = "_corrupt_record"

PULL_RESPONSE = T.StructType(
    [T.StructField("receivedMessages", T.ArrayType(MESSAGE)),
     T.StructField(UNREADABLE, T.StringType())]
)

# Envelope fields without which a message cannot be applied.
ENVELOPE_REQUIRED = ["ackId", "message.messageId", "message.publishTime", "message.data"] + [
    f"message.attributes.{n}" for n in ("notificationConfig", "eventType", "eventTime", "payloadFormat",
                                        "bucketId", "objectId", "objectGeneration")]

_ACL = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "kind",
            "id",
            "selfLink",
            "bucket",
            "object",
            "generation",
            "entity",
            "role",
            "email",
            "entityId",
            "domain",
            "etag",
        )
    ]
    + [
        T.StructField(
            "projectTeam",
            T.StructType(
                [
                    T.StructField("projectNumber", T.StringType()),
                    T.StructField("team", T.StringType()),
                ]
            ),
        )
    ]
)

PAYLOAD = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("selfLink", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("generation", T.StringType()),
        T.StructField("metageneration", T.StringType()),
        T.StructField("contentType", T.StringType()),
        T.StructField("timeCreated", T.TimestampType()),
        T.StructField("updated", T.TimestampType()),
        T.StructField("timeDeleted", T.TimestampType()),
        T.StructField("temporaryHold", T.BooleanType()),
        T.StructField("eventBasedHold", T.BooleanType()),
        T.StructField("retentionExpirationTime", T.TimestampType()),
        T.StructField("storageClass", T.StringType()),
        T.StructField("timeStorageClassUpdated", T.TimestampType()),
        T.StructField("size", T.StringType()),
        T.StructField("md5Hash", T.StringType()),
        T.StructField("mediaLink", T.StringType()),
        T.StructField("contentEncoding", T.StringType()),
        T.StructField("contentDisposition", T.StringType()),
        T.StructField("contentLanguage", T.StringType()),
        T.StructField("cacheControl", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("acl", T.ArrayType(_ACL)),
        T.StructField(
            "owner",
            T.StructType(
                [
                    T.StructField("entity", T.StringType()),
                    T.StructField("entityId", T.StringType()),
                ]
            ),
        ),
        T.StructField("crc32c", T.StringType()),
        T.StructField("componentCount", T.LongType()),
        T.StructField("etag", T.StringType()),
        T.StructField(
            "customerEncryption",
            T.StructType(
                [
                    T.StructField("encryptionAlgorithm", T.StringType()),
                    T.StructField("keySha256", T.StringType()),
                ]
            ),
        ),
        T.StructField("kmsKeyName", T.StringType()),
    ]
)

# Payload keys without which a notification cannot be applied.
PAYLOAD_REQUIRED = [
    "kind",
    "id",
    "selfLink",
    "name",
    "bucket",
    "size",
    "timeCreated",
    "updated",
    "timeStorageClassUpdated",
]

# Flat notification row: what the router works on after decoding.
NOTIFICATION_COLUMNS = [
    "ack_id",
    "message_id",
    "publish_time",
    "event_type",
    "event_time",
    "object_id",
    "overwritten_by_generation",
    "data",
]

# ---------------------------------------------------------------------------
# Messages kept with a registry
# ---------------------------------------------------------------------------

DECODED = T.StructType([
    T.StructField("ack_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("publish_time", TS),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", TS),
    T.StructField("overwritten_by_generation", T.StringType()),
    T.StructField("object_name", T.StringType()),
    T.StructField("self_link", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("partition_name", T.StringType()),
    T.StructField("reason", T.StringType()),
])
DEAD = T.StructType([
    T.StructField("ack_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("event_time", TS),
    T.StructField("object_name", T.StringType()),
    T.StructField("reason", T.StringType()),
])
