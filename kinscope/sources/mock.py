"""A synthetic dataset of fifteen entities in five families, the same for a seed everywhere."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20260101

# The fixture's features (id, name, categories), those almost all entities have, the cores of its
# families (key, label, core), and its entities (name, family, aliases).
CATALOGUE = [
    ("T1003", "OS Credential Dumping", ["credential-access"]),
    ("T1005", "Data from Local System", ["collection"]),
    ("T1007", "System Service Discovery", ["discovery"]),
    ("T1012", "Query Registry", ["discovery"]),
    ("T1016", "System Network Configuration Discovery", ["discovery"]),
    ("T1018", "Remote System Discovery", ["discovery"]),
    ("T1021", "Remote Services", ["lateral-movement"]),
    ("T1027", "Obfuscated Files or Information", ["defense-evasion"]),
    ("T1033", "System Owner/User Discovery", ["discovery"]),
    ("T1036", "Masquerading", ["defense-evasion"]),
    ("T1039", "Data from Network Shared Drive", ["collection"]),
    ("T1041", "Exfiltration Over C2 Channel", ["exfiltration"]),
    ("T1046", "Network Service Discovery", ["discovery"]),
    ("T1047", "Windows Management Instrumentation", ["execution"]),
    ("T1049", "System Network Connections Discovery", ["discovery"]),
    ("T1053", "Scheduled Task/Job", ["execution", "persistence", "privilege-escalation"]),
    ("T1055", "Process Injection", ["defense-evasion", "privilege-escalation"]),
    ("T1056", "Input Capture", ["collection", "credential-access"]),
    ("T1057", "Process Discovery", ["discovery"]),
    ("T1059", "Command and Scripting Interpreter", ["execution"]),
    ("T1068", "Exploitation for Privilege Escalation", ["privilege-escalation"]),
    ("T1070", "Indicator Removal", ["defense-evasion"]),
    ("T1071", "Application Layer Protocol", ["command-and-control"]),
    ("T1074", "Data Staged", ["collection"]),
    ("T1078", "Valid Accounts", ["defense-evasion", "persistence", "initial-access"]),
    ("T1082", "System Information Discovery", ["discovery"]),
    ("T1083", "File and Directory Discovery", ["discovery"]),
    ("T1087", "Account Discovery", ["discovery"]),
    ("T1090", "Proxy", ["command-and-control"]),
    ("T1095", "Non-Application Layer Protocol", ["command-and-control"]),
    ("T1102", "Web Service", ["command-and-control"]),
    ("T1105", "Ingress Tool Transfer", ["command-and-control"]),
    ("T1106", "Native API", ["execution"]),
    ("T1110", "Brute Force", ["credential-access"]),
    ("T1112", "Modify Registry", ["defense-evasion"]),
    ("T1113", "Screen Capture", ["collection"]),
    ("T1114", "Email Collection", ["collection"]),
    ("T1119", "Automated Collection", ["collection"]),
    ("T1132", "Data Encoding", ["command-and-control"]),
    ("T1133", "External Remote Services", ["initial-access", "persistence"]),
    ("T1134", "Access Token Manipulation", ["defense-evasion", "privilege-escalation"]),
    ("T1135", "Network Share Discovery", ["discovery"]),
    ("T1140", "Deobfuscate/Decode Files or Information", ["defense-evasion"]),
    ("T1189", "Drive-by Compromise", ["initial-access"]),
    ("T1190", "Exploit Public-Facing Application", ["initial-access"]),
    ("T1195", "Supply Chain Compromise", ["initial-access"]),
    ("T1199", "Trusted Relationship", ["initial-access"]),
    ("T1204", "User Execution", ["execution"]),
    ("T1210", "Exploitation of Remote Services", ["lateral-movement"]),
    ("T1213", "Data from Information Repositories", ["collection"]),
    ("T1218", "System Binary Proxy Execution", ["defense-evasion"]),
    ("T1485", "Data Destruction", ["impact"]),
    ("T1486", "Data Encrypted for Impact", ["impact"]),
    ("T1489", "Service Stop", ["impact"]),
    ("T1490", "Inhibit System Recovery", ["impact"]),
    ("T1491", "Defacement", ["impact"]),
    ("T1499", "Endpoint Denial of Service", ["impact"]),
    ("T1505", "Server Software Component", ["persistence"]),
    ("T1543", "Create or Modify System Process", ["persistence", "privilege-escalation"]),
    ("T1547", "Boot or Logon Autostart Execution", ["persistence", "privilege-escalation"]),
    ("T1550", "Use Alternate Authentication Material", ["defense-evasion", "lateral-movement"]),
    ("T1552", "Unsecured Credentials", ["credential-access"]),
    ("T1553", "Subvert Trust Controls", ["defense-evasion"]),
    ("T1560", "Archive Collected Data", ["collection"]),
    ("T1562", "Impair Defenses", ["defense-evasion"]),
    ("T1566", "Phishing", ["initial-access"]),
    ("T1567", "Exfiltration Over Web Service", ["exfiltration"]),
    ("T1569", "System Services", ["execution"]),
    ("T1570", "Lateral Tool Transfer", ["lateral-movement"]),
    ("T1573", "Encrypted Channel", ["command-and-control"]),
    ("T1574", "Hijack Execution Flow", ["defense-evasion", "persistence"]),
    ("T1583", "Acquire Infrastructure", ["resource-development"]),
    ("T1585", "Establish Accounts", ["resource-development"]),
    ("T1588", "Obtain Capabilities", ["resource-development"]),
    ("T1592", "Gather Victim Host Information", ["reconnaissance"]),
    ("T1608", "Stage Capabilities", ["resource-development"]),
]
COMMON = ["T1059", "T1082", "T1083", "T1105", "T1071", "T1057", "T1027"]
FAMILIES = [
    ("espionage", "Long-dwell espionage", ["T1566", "T1078", "T1047", "T1003", "T1560", "T1567", "T1114", "T1074", "T1021", "T1113"]),
    ("ransomware", "Big-game ransomware", ["T1190", "T1133", "T1110", "T1486", "T1490", "T1489", "T1570", "T1112", "T1018", "T1562"]),
    ("implant", "Supply-chain implant", ["T1195", "T1574", "T1573", "T1070", "T1140", "T1553", "T1218", "T1543", "T1132", "T1090"]),
    ("disruption", "Disruption and defacement", ["T1485", "T1491", "T1499", "T1190", "T1102", "T1583", "T1585", "T1608", "T1204", "T1592"]),
    ("financial", "Financially motivated intrusion", ["T1204", "T1036", "T1055", "T1056", "T1005", "T1041", "T1552", "T1550", "T1213", "T1119"]),
]
ENTITIES = [
    ("SILENT HERON", "espionage", ["HERON-07", "Cluster Alpha"]),
    ("PALE LANTERN", "espionage", ["LANTERN GROUP"]),
    ("GLASS MERIDIAN", "espionage", ["MERIDIAN-3", "GM-Actor"]),
    ("IRON TIDE", "ransomware", ["TIDE CREW", "IT-2021"]),
    ("RUST HALO", "ransomware", ["HALO-9"]),
    ("BLUNT MERCURY", "ransomware", ["MERCURY CREW"]),
    ("HOLLOW ORCHID", "implant", ["ORCHID-11", "Quiet Bloom"]),
    ("QUIET FILAMENT", "implant", ["FILAMENT GROUP"]),
    ("VELVET CIPHER", "implant", ["CIPHER-5"]),
    ("ASHEN KITE", "disruption", ["KITE-4", "Ash Flock"]),
    ("SCARLET FURROW", "disruption", ["FURROW GROUP"]),
    ("BROKEN COMPASS", "disruption", ["COMPASS-2"]),
    ("COPPER FINCH", "financial", ["FINCH-8", "Copper Crew"]),
    ("AMBER TOLL", "financial", ["TOLL GROUP"]),
    ("NIGHT LEDGER", "financial", ["LEDGER-6"]),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(feature_id, feature_name, categories) of the fixture."""
    return spark.createDataFrame(CATALOGUE, "feature_id string, feature_name string, categories array<string>")


def entities(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """(entity_id, entity_name, aliases, feature_ids, source, metadata): 7 to 9 of a family's ten core features, each common one with odds 0.85, 3 to 6 of any.

    One random stream runs through all entities, so a seed gives the same table on every machine.
    """
    rng, out = random.Random(seed), []
    everything = [feature for feature, _, _ in CATALOGUE]
    family = {f: (label, core) for f, label, core in FAMILIES}
    for name, group, aliases in ENTITIES:
        label, core = family[group]
        n = rng.randint(7, 9)
        own = set(rng.sample(core, n))
        own |= {f for f in COMMON if rng.random() < 0.85}
        n = rng.randint(3, 6)
        own |= set(rng.sample(everything, n))
        about = {"family": group, "family_label": label, "synthetic": "true", "seed": str(seed)}
        out.append((f"mock--{name.lower().replace(' ', '-')}", name, aliases, sorted(own), "mock", about))
    return spark.createDataFrame(out, "entity_id string, entity_name string, aliases array<string>, feature_ids array<string>, source string, metadata map<string,string>")


def ground_truth(rows: DataFrame) -> DataFrame:
    """(entity_id, entity_name, family, family_label, features) of the fixture's entities."""
    return rows.select("entity_id", "entity_name", F.col("metadata")["family"].alias("family"), F.col("metadata")["family_label"].alias("family_label"), F.size("feature_ids").alias("features"))


def edges(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", F.explode("feature_ids").alias("feature_id"))
