"""Record kinds of the newest schema version and what older versions lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The host of records that are older than hosts.
NO_HOST = "00000000-0000-0000-0000-000000000001"
#: Fields of each kind in the newest version, in the schema's order; fixed values.
FIELDS = {
    "Event": ("uuid", "sequence", "eventType", "threadId", "host", "subjectUuid", "timestampNanos", "predicateObject", "predicateObjectPath", "predicateObject2", "predicateObject2Path", "names", "parameters", "location", "size", "programPoint", "properties"),
    "FileObject": ("uuid", "host", "baseObject", "fileObjectType", "fileDescriptor", "localPrincipal", "size", "peInfo", "hashes"),
    "MemoryObject": ("uuid", "host", "baseObject", "memoryAddress", "pageNumber", "pageOffset", "size"),
    "NetFlowObject": ("uuid", "host", "baseObject", "localAddress", "localPort", "remoteAddress", "remotePort", "ipProtocol", "initTcpSeqNum", "fileDescriptor"),
    "Principal": ("uuid", "userId", "groupIds", "principalType", "host", "username", "properties"),
    "SrcSinkObject": ("uuid", "host", "baseObject", "srcSinkType", "fileDescriptor"),
    "Subject": ("uuid", "subjectType", "cid", "localPrincipal", "startTimestampNanos", "parentSubject", "host", "unitId", "iteration", "count", "cmdLine", "privilegeLevel", "importedLibraries", "exportedLibraries", "properties"),
    "TimeMarker": ("timestampNanos", "host"),
    "UnitDependency": ("unit", "dependentUnit", "host"),
    "Host": ("uuid", "hostName", "ta1Version", "hostIdentifiers", "osDetails", "hostType", "interfaces"),
}
#: The version that a field came with, and its value (SQL) in older records; fixed values. A host's own record has no host.
ADDED = {"host": (19, f"'{NO_HOST}'"), "initTcpSeqNum": (20, "cast(null as bigint)"), "ta1Version": (20, "''")}


def to_newest(records: dict[int, DataFrame], kind: str) -> DataFrame:
    """Records of one kind from several versions (version: frame) in the columns of the newest, with ``from_version``.

    A field that a version lacked gets its default there, whatever the frame holds; others that a frame lacks are null.
    """
    out = None
    for version, df in sorted(records.items()):
        columns = []
        for name in FIELDS[kind]:
            since, default = ADDED.get(name, (0, "null"))
            columns.append((F.expr(default) if version < since else F.col(name) if name in df.columns else F.lit(None)).alias(name))
        rows = df.select(*columns, F.lit(version).alias("from_version"))
        out = rows if out is None else out.unionByName(rows)
    return out
