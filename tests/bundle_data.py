"""A small bundle with every edge case of the parsers, written by hand."""

REF = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": f"https://example.org/{i}"}]


def rel(kind, src, dst, **more):
    return {"type": "relationship", "id": f"relationship--{src}{dst}", "relationship_type": kind, "source_ref": src, "target_ref": dst, **more}


OBJECTS = [
    {"type": "attack-pattern", "id": "attack-pattern--1", "name": "Valid Accounts", "description": "Adversaries may abuse credentials.", "external_references": REF("T1078"), "kill_chain_phases": [{"phase_name": "initial-access"}, {"phase_name": "nowhere"}], "x_mitre_platforms": ["Windows", "Linux"]},
    {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Domain Accounts", "external_references": [{"source_name": "other", "external_id": "X-9"}, *REF("T1078.002")], "x_mitre_is_subtechnique": True, "x_mitre_deprecated": False, "kill_chain_phases": [{"phase_name": "initial-access"}]},
    {"type": "attack-pattern", "id": "attack-pattern--3", "name": "Old", "revoked": True, "external_references": REF("T1")},
    {"type": "attack-pattern", "id": "attack-pattern--4", "name": "Older", "x_mitre_deprecated": True},
    {"type": "attack-pattern", "id": "attack-pattern--5", "name": "Accounts", "description": None, "external_references": REF("T1555"), "x_mitre_platforms": ["macOS"]},
    {"type": "intrusion-set", "id": "intrusion-set--1", "name": "Velvet Bear", "description": "Velvet Bear is a stealthy group that likes doors.", "aliases": ["Velvet Bear", "APT77", "SoftPaw"], "external_references": REF("G0001")},
    {"type": "intrusion-set", "id": "intrusion-set--2", "name": "Amber Panda", "description": "Amber Panda is a noisy group.", "aliases": ["APT78"], "external_references": REF("G0002")},
    {"type": "malware", "id": "malware--1", "name": "Gloomware", "description": "Gloomware is a backdoor used by many.", "x_mitre_aliases": ["Gloomware", "GloomWorm"], "x_mitre_platforms": ["Windows"], "external_references": REF("S0001")},
    {"type": "tool", "id": "tool--1", "name": "Doorpick", "x_mitre_aliases": ["Doorpick"], "external_references": REF("S0002")},
    {"type": "tool", "id": "tool--2", "name": "Doorpick", "external_references": REF("S0003")},
    {"type": "course-of-action", "id": "course-of-action--1", "name": "Rotate Keys", "external_references": REF("M1001")},
    {"type": "x-mitre-tactic", "id": "x-mitre-tactic--1", "name": "Initial Access", "x_mitre_shortname": "initial-access", "description": "The adversary is trying to get into your network through doorways.", "external_references": REF("TA0001")},
    {"type": "x-mitre-tactic", "id": "x-mitre-tactic--2", "name": "Exfiltration", "x_mitre_shortname": "exfiltration", "description": "The adversary is trying to steal data.", "external_references": REF("TA0010")},
    {"type": "campaign", "id": "campaign--1", "name": "Silent Harbour", "first_seen": "2021-01-01T00:00:00Z", "external_references": REF("C0001")},
    {"type": "x-mitre-data-component", "id": "x-mitre-data-component--1", "name": "Logon Events", "external_references": REF("DC0001"), "x_mitre_log_sources": [{"name": "wineventlog"}]},
    {"type": "x-mitre-analytic", "id": "x-mitre-analytic--1", "name": "Analytic 1", "description": "Looks at logons", "external_references": REF("AN0001"), "x_mitre_log_source_references": [{"x_mitre_data_component_ref": "x-mitre-data-component--1"}, {"other": "x"}]},
    {"type": "x-mitre-analytic", "id": "x-mitre-analytic--2", "name": "Analytic 2", "description": "Looks at nothing", "external_references": REF("AN0002")},
    {"type": "x-mitre-detection-strategy", "id": "x-mitre-detection-strategy--1", "name": "Watch Logons", "description": "dropped", "external_references": REF("DET0001"), "x_mitre_analytic_refs": ["x-mitre-analytic--1", "x-mitre-analytic--2", "x-mitre-analytic--9"]},
    rel("uses", "intrusion-set--1", "attack-pattern--1"),
    rel("uses", "intrusion-set--1", "attack-pattern--1", id="again"),
    rel("uses", "intrusion-set--1", "malware--1"),
    rel("uses", "intrusion-set--1", "tool--1"),
    rel("uses", "intrusion-set--1", "tool--2"),
    rel("uses", "intrusion-set--2", "tool--1"),
    rel("uses", "malware--1", "attack-pattern--1"),
    rel("uses", "campaign--1", "attack-pattern--1"),
    rel("attributed-to", "campaign--1", "intrusion-set--1"),
    rel("mitigates", "course-of-action--1", "attack-pattern--1"),
    rel("subtechnique-of", "attack-pattern--2", "attack-pattern--1"),
    rel("subtechnique-of", "attack-pattern--2", "attack-pattern--5"),
    rel("detects", "x-mitre-detection-strategy--1", "attack-pattern--1"),
    rel("uses", "intrusion-set--9", "attack-pattern--1"),
    rel("uses", "intrusion-set--1", "attack-pattern--3"),
    rel("uses", "x-mitre-tactic--1", "attack-pattern--1"),
    rel("uses", "intrusion-set--2", "attack-pattern--1", revoked=True),
]
