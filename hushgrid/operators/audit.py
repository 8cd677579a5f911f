"""Hash-chained ledgers, encryption, signatures and receipts."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def event_hash(sequence: Column, event_type: Column, ts: Column, details: Column, prev: Column) -> Column:
    """SHA-256 of the event as JSON, fields by name."""
    return F.sha2(F.to_json(F.struct(details.alias("details"), event_type.alias("event_type"), prev.alias("prev_hash"), sequence.alias("sequence"), ts.alias("timestamp"))), 256)


def chain(events: DataFrame) -> DataFrame:
    """job_id, sequence, event_type, timestamp, details, prev_hash, event_hash: each event linked to the one before.

    The fold is over one job's events, in order, inside the JVM.
    """
    step = lambda acc, e: F.struct(
        event_hash(e["sequence"], e["event_type"], e["timestamp"], e["details"], acc["last"]).alias("last"),
        F.concat(acc["out"], F.array(F.struct(e["sequence"].alias("sequence"), e["event_type"].alias("event_type"), e["timestamp"].alias("timestamp"), e["details"].alias("details"), acc["last"].alias("prev_hash"), event_hash(e["sequence"], e["event_type"], e["timestamp"], e["details"], acc["last"]).alias("event_hash")))).alias("out"),
    )
    rows = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "event_type", "timestamp", "details"))).alias("events"))
    empty = F.expr("cast(array() as array<struct<sequence:bigint,event_type:string,timestamp:string,details:string,prev_hash:string,event_hash:string>>)")
    folded = rows.select("job_id", F.aggregate("events", F.struct(F.lit(GENESIS).alias("last"), empty.alias("out")), step).alias("f"))
    return folded.select("job_id", F.inline("f.out"))


def verify(ledger: DataFrame) -> DataFrame:
    """job_id, valid, event_count, chain_head, first_bad: sequence, link and hash of every event checked by window."""
    by = Window.partitionBy("job_id").orderBy("sequence")
    prev, seq = F.lag("event_hash", 1, GENESIS).over(by), F.row_number().over(by)
    good = (F.col("sequence") == seq) & (F.col("prev_hash") == prev) & (F.col("event_hash") == event_hash(F.col("sequence"), F.col("event_type"), F.col("timestamp"), F.col("details"), F.col("prev_hash")))
    marked = ledger.withColumn("good", good)
    return marked.groupBy("job_id").agg(F.bool_and("good").alias("valid"), F.count(F.lit(1)).alias("event_count"), F.max_by("event_hash", "sequence").alias("chain_head"), F.min(F.when(~F.col("good"), F.col("sequence"))).alias("first_bad"))


def subkeys(secret: bytes, salt: bytes = b"") -> tuple[bytes, bytes]:
    """Two keys by HKDF-SHA256: one to encrypt, one for fingerprints."""
    root = hmac.new(salt or b"\0" * 32, secret, hashlib.sha256).digest()

    def expand(info: bytes) -> bytes:
        return hmac.new(root, info + b"\1", hashlib.sha256).digest()

    return expand(b"hushgrid encryption"), expand(b"hushgrid fingerprint")


def encrypt(content: Column, key: Column, job: Column, doc: Column, nonce: Column) -> Column:
    """AES-256-GCM; the text that is authenticated besides names job and document."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.concat(F.lit("hushgrid:"), job, F.lit(":"), doc))


def decrypt(sealed: Column, key: Column, job: Column, doc: Column) -> Column:
    """The content, or null if key, job, document or bytes are not those that were sealed."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit("hushgrid:"), job, F.lit(":"), doc))


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode("utf-8")


class Signer:
    """Ed25519 by the JVM's own provider."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        pair = self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
        self.private, self.public = pair.getPrivate(), pair.getPublic()

    def sign(self, value) -> bytes:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self.private)
        s.update(canonical_json(value))
        return bytes(s.sign())

    def verify(self, value, signature: bytes) -> bool:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initVerify(self.public)
        s.update(canonical_json(value))
        try:
            return bool(s.verify(signature))
        except Exception:  # a signature of the wrong length is an error of the provider
            return False


def certificate(signer: Signer, job: str, gates: list[dict], head: str, output_sha256: str) -> dict:
    """A signed statement that all gates passed; refused otherwise."""
    if not gates or any(g["status"] != "PASS" for g in gates):
        raise ValueError("not releasable: a gate did not pass")
    body = {"job_id": job, "gates": sorted((g["name"], g["status"]) for g in gates), "audit_head": head, "output_sha256": output_sha256}
    return {"body": body, "signature": signer.sign(body).hex()}


def bundle(path: str, parts: dict[str, bytes]) -> dict[str, str]:
    """Write parts and an index of their hashes to a zip with fixed times; returns the index."""
    import zipfile

    index = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(parts.items())}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [*sorted(parts.items()), ("index.json", canonical_json(index))]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return index


def verify_bundle(path: str, max_members: int = 2_000, max_bytes: int = 64 << 20) -> bool:
    import zipfile

    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        if len(infos) > max_members or sum(i.file_size for i in infos) > max_bytes:
            return False
        index = json.loads(z.read("index.json"))
        return {i.filename for i in infos} - {"index.json"} == set(index) and all(hashlib.sha256(z.read(n)).hexdigest() == h for n, h in index.items())


def receipts(jobs: DataFrame, counts: DataFrame, old: DataFrame) -> DataFrame:
    """Receipts of destroyed jobs; a job that has one keeps it."""
    new = jobs.join(counts, "job_id").select("job_id", "destroyed_at", "deleted", F.sha2(F.concat_ws("|", "job_id", F.col("destroyed_at").cast("string"), F.col("deleted").cast("string")), 256).alias("receipt_sha256"))
    return old.unionByName(new.join(old.select("job_id"), "job_id", "left_anti"))


def last_events(ledger: DataFrame) -> DataFrame:
    """job_id, sequence, event_type of each job's last event."""
    return ledger.groupBy("job_id").agg(F.max("sequence").alias("sequence"), F.max_by("event_type", "sequence").alias("event_type"))
