"""The graph model: vertex and edge types, groups of edge types, schemas."""

from __future__ import annotations

#: Vertex types.
NODE_TYPES = [
    "Namespace", "Class", "Struct", "Interface", "Method", "Delegate", "Property", "Field", "Event", "Indexer", "Operator", "Enum", "File", "Module",
    "ExternalConcept", "DatabaseTable", "ApiEndpoint", "MessageTopic", "ExternalService", "Diagnostic", "IndexRun", "ConfigurationFile", "ConfigurationKey",
    "ConfigurationEntry",
]
#: Edge types.
EDGE_TYPES = [
    "Contains", "Calls", "Implements", "Inherits", "Uses", "UsesClass", "UsesId", "DependsOn", "Overrides", "DefinesSelector", "ImportsStyle",
    "UsesCssVariable", "DefinesCssVariable", "Reads", "Writes", "PublishesTo", "SubscribesTo", "DefinesConfig", "OverridesConfig", "ReadsConfig", "BindsConfig",
]
FILE_ROLES = ["Source", "Test", "Migration", "Snapshot", "Generated", "BuildArtifact", "Configuration", "Unknown"]
#: Groups of edge types.
STRUCTURAL = [
    "Calls", "Uses", "DependsOn", "UsesClass", "UsesId", "DefinesSelector", "ImportsStyle", "UsesCssVariable", "DefinesCssVariable",
    "Reads", "Writes", "PublishesTo", "SubscribesTo",
]
TRAVERSAL = [*STRUCTURAL, "Implements", "Inherits"]
COARSE = ["Calls", "Uses", "DependsOn"]
ENDPOINT = ["Calls", "Uses", "Reads", "Writes", "PublishesTo", "SubscribesTo"]
COMMUNITY = ["Calls", "Uses", "UsesClass", "DependsOn", "Contains"]
COVERING = ["Calls", "Uses", "DependsOn", "UsesClass", "UsesId", "DefinesSelector", "ImportsStyle", "UsesCssVariable", "DefinesCssVariable"]
#: Vertex types that stand beside the code.
WORKFLOW = ["ApiEndpoint", "File", "ExternalConcept", "MessageTopic", "ExternalService", "Diagnostic", "ConfigurationFile", "ConfigurationKey", "ConfigurationEntry"]
PRODUCTION_ROLES = ["Source", "Unknown"]
#: Default layers, name and the namespace parts that show it; forbidden dependencies between layers, in order.
LAYERS = {
    "Core": [".Core", ".Domain"],
    "Application": [".Application"],
    "Infrastructure": [".Infrastructure", ".Persistence"],
    "Presentation": [".Api", ".Web", ".UI", ".McpServer"],
}
FORBIDDEN = [
    ("Core", "Application"), ("Core", "Infrastructure"), ("Core", "Presentation"), ("Application", "Infrastructure"), ("Application", "Presentation"),
]

NODE_SCHEMA = (
    "id string, name string, type string, namespace string, file_path string, line_number int, line_count int, summary string, source_hash string, "
    "file_role string, project_context string, change_count bigint, created_at timestamp, updated_at timestamp, properties map<string,string>"
)
EDGE_SCHEMA = "src string, dst string, type string, confidence double"


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
