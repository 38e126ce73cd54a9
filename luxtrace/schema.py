"""Fixed values, tables and column types of the provenance engine."""

from __future__ import annotations

import os

from pyspark.sql import types as T

#: Hashes, commitments and content ids are bound to a namespace, that of the registry whose records are read: set
#: ``LUXTRACE_NAMESPACE`` on the driver and the executors to the registry's own.
NAMESPACE = os.environ.get("LUXTRACE_NAMESPACE", "luxtrace")
RECORD_TAG, PIXEL_TAG, FINGERPRINT_TAG, BODY_TAG, SESSION_TAG = (f"{NAMESPACE}-{kind}".encode() for kind in ("record-v1", "pixels-v1", "prnu-k-v1", "body-v1", "session"))
CID_PREFIX = f"{NAMESPACE}:"
# Thresholds and widths that decide results.
PCE_THRESHOLD = 100.0
SATURATION_LEVEL = 0.99
SATURATION_WARN = 0.01
DETAIL_FLOOR = 200.0
HAMMING_RADIUS = 10
MOST_CONFIRMED = 10
LEAST_SAMPLES = 50
# File name endings of camera raw files, and programs whose output is not the camera's own JPEG.
RAW_SUFFIXES = (".cr3", ".cr2", ".crw", ".nef", ".arw", ".dng", ".raf", ".rw2")
DESKTOP_SOFTWARE = ("adobe", "photoshop", "lightroom", "acd", "capture one", "darktable", "rawtherapee", "affinity", "dxo", "luminar", "gimp", "pixelmator", "apple", "preview")
# Names of modification levels in the file report and in the public record.
LEVELS_REPORT = ("unedited RAW", "adjusted", "generative edit")
LEVELS_RECORD = ("unedited raw", "adjusted", "generative edit")

# Chains on which a registry may be reset, and chains on which none may.
TEST_CHAINS, MAIN_CHAINS = (11155111, 84532, 17000, 31337, 1337), (1, 8453)

ZERO_WORD = "0x" + "0" * 64

#: One row for each registry event; payload columns that a kind lacks are null.
EVENTS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("block_number", T.LongType()), ("log_index", T.IntegerType()), ("tx_hash", T.StringType()), ("block_timestamp", T.LongType()), ("kind", T.StringType()),
        ("body_id", T.StringType()), ("owner", T.StringType()), ("to_address", T.StringType()), ("body_commitment", T.StringType()),
        ("image_hash", T.StringType()), ("perceptual_hash", T.StringType()), ("parent_hash", T.StringType()), ("level", T.IntegerType()), ("metadata_hmac", T.StringType()), ("pce", T.LongType()),
        ("session_id", T.StringType()), ("merkle_root", T.StringType()), ("frame_count", T.LongType()), ("recorder", T.StringType()), ("asset_cid", T.StringType()), ("commit_data", T.StringType()),
        ("subject", T.StringType()), ("by_address", T.StringType()), ("attest_kind", T.StringType()), ("data_hash", T.StringType()), ("evidence_hash", T.StringType()),
    )]
)

KINDS = ("BodyRegistered", "BodyRevoked", "BodyTransferred", "ImageRegistered", "SessionCommitted", "Commit", "RegistryReset", "Attested", "Challenged")

#: The local catalogue of registered photographs, keyed by image_hash.
CATALOGUE = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("image_hash", T.StringType()), ("perceptual_hash", T.StringType()), ("body_id", T.StringType()), ("body_name", T.StringType()), ("pce", T.DoubleType()), ("registered_at", T.LongType()), ("tx_hash", T.StringType()),
        ("block_number", T.LongType()), ("session_id", T.StringType()), ("file_name", T.StringType()), ("file_path", T.StringType()), ("description", T.StringType()), ("noted_at", T.LongType()),
    )]
)

#: A plane of samples: of a frame, or of a fingerprint.
PLANE = "plane int, h int, w int, data array<float>"
