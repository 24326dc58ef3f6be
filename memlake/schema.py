"""Grain types, fields and the canonical columns."""

from __future__ import annotations

from dataclasses import dataclass

# Grain types, their plural names, fields that must be given, and fields of their own.
_TYPES = """
fact        facts           subject,relation,object             subject,relation,object,confidence
event       events          content                             role,session_id,parent_message_id,model_id,content,created_at,stop_reason,run_id
state       states          -                                   context,plan,history
workflow    workflows       nodes                               node,binding,nodes,edges,bindings,name,retries
tool        tools           tool_name                           tool_name,kind,status,is_error,tool_call_id,tool,input,duration_ms
observation observations    observer_id,observer_type           observer_id,observer_type,sensor,value,unit
goal        goals           description                         goal_state,assigned_agent,deadline,depends_on,title,description,parent_hash
reasoning   reasonings      -                                   reasoning_type,premises,conclusion
consensus   consensuses     -                                   threshold,agreement_count,participating_observers
consent     consents        subject_did                         consent_action,purpose,grantor_did,grantee_did,expires_at,granted,subject_did
skill       skills          name,description                    name,version,domain,holder_did,proficiency,transferable,practice_count,last_practiced_at,instructions,when_to_use
recommendation recommendations target_ref,analyzer,summary,dedup_key target_ref,analyzer,severity,dedup_key,rec_status
trigger     triggers        kind,workflow                       kind,workflow,connector,scope,enabled,cron
"""

ADDABLE = ("fact", "goal", "observation", "skill")

COMMON = (
    "hash grain_type type score namespace ns subject relation object content confidence importance created_at seq session_id run_id "
    "user_id role derived_from valid_from valid_to sys_from sys_to superseded_by supersedes tags text"
).split()

# Defaults of fields that are left out when they have them.
OMITTED = {"kind": "execution", "status": "completed"}

NUMERIC = {"confidence", "importance", "created_at", "seq", "score", "valid_from", "valid_to", "sys_from", "sys_to", "value", "duration_ms", "proficiency", "practice_count", "deadline", "progress", "threshold", "agreement_count", "expires_at"}
BOOLEAN = {"is_error", "granted", "transferable", "enabled"}


@dataclass(frozen=True)
class GrainType:
    name: str
    plural: str
    required: tuple[str, ...]
    fields: tuple[str, ...]


TYPES = {
    name: GrainType(name, plural, () if need == "-" else tuple(need.split(",")), tuple(own.split(",")))
    for name, plural, need, own in (line.split() for line in _TYPES.strip().splitlines())
}
PLURALS = {t.plural: t.name for t in TYPES.values()}

#: All columns of a grains table; what a type has beyond them is in attrs.
COLUMNS = {
    "seq": "bigint", "hash": "string", "ns": "string", "grain_type": "string", "created_at": "bigint", "subject": "string", "relation": "string", "object": "string",
    "content": "string", "confidence": "double", "importance": "double", "session_id": "string", "run_id": "string", "user_id": "string", "role": "string",
    "derived_from": "string", "valid_from": "bigint", "valid_to": "bigint", "superseded_by": "string", "supersedes": "string", "tags": "array<string>",
    "text": "string", "attrs": "map<string,string>",
}
