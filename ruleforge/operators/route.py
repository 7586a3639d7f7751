"""Which rules apply to which events: indexes and conditions of configurations, and channels of log sources."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleforge.rules.model import Config, Logsource, Rule, Search

from .options import Options
from .search import Compiler, all_of, any_of


@dataclass
class Route:
    """Where a rule's events are: index names or globs, further conditions, and how those combine."""

    indexes: list[str]
    conditions: list[Search]
    merging: str = "and"


def route_of(rule: Rule, configs: list[Config]) -> Route:
    """A mapping applies if each part that it names equals the rule's; its rewrite holds for the mappings after it."""
    source, indexes, conditions, merging = rule.logsource, [], [], "and"
    for config in configs:
        if config.logsource_merging == "or":
            merging = "or"
        matched = False
        for mapping in config.logsources:
            own = mapping.logsource
            if any(a and a != b for a, b in ((own.category, source.category), (own.product, source.product), (own.service, source.service))):
                continue
            matched = True
            indexes += mapping.index
            new = mapping.rewrite
            source = replace(source, category=new.category or source.category, product=new.product or source.product, service=new.service or source.service)
            if mapping.conditions.keywords or mapping.conditions.matchers:
                conditions.append(mapping.conditions)
        if not matched and config.default_index:
            indexes.append(config.default_index)
    return Route(indexes, conditions, merging)


def index_pattern(glob: str) -> str:
    return "\\A" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "\\z"


def relevant(df: DataFrame, rule: Rule, index: Column, options: Options) -> Column:
    """Whether a rule applies to an event of this index. Without indexes it never does."""
    route = route_of(rule, options.configs)
    compiler: Compiler = options.compiler(df)
    place = any_of([index.rlike(index_pattern(i)) if set(i) & set("*?") else index == i for i in route.indexes])
    tests = [compiler.search(s) for s in route.conditions]
    extra = F.lit(True) if not tests else any_of(tests) if route.merging == "or" else all_of(tests)
    return F.coalesce(place & extra, F.lit(False))


# The channels of services and categories, as the rule format's log sources name them.
SERVICES: dict[str, tuple[str, ...]] = {
    "security": ("Security",),
    "system": ("System",),
    "application": ("Application",),
    "sysmon": ("Microsoft-Windows-Sysmon/Operational",),
    "powershell": ("Microsoft-Windows-PowerShell/Operational",),
    "powershell-classic": ("Windows PowerShell",),
    "taskscheduler": ("Microsoft-Windows-TaskScheduler/Operational",),
    "wmi": ("Microsoft-Windows-WMI-Activity/Operational",),
    "windefend": ("Microsoft-Windows-Windows Defender/Operational",),
    "dns-server": ("DNS Server",),
    "dns-server-audit": ("Microsoft-Windows-DNS-Server/Audit",),
    "firewall-as": ("Microsoft-Windows-Windows Firewall With Advanced Security/Firewall",),
    "bits-client": ("Microsoft-Windows-Bits-Client/Operational",),
    "ntlm": ("Microsoft-Windows-NTLM/Operational",),
    "smbclient-security": ("Microsoft-Windows-SmbClient/Security",),
    "ldap_debug": ("Microsoft-Windows-LDAP-Client/Debug",),
    "codeintegrity-operational": ("Microsoft-Windows-CodeIntegrity/Operational",),
    "printservice-admin": ("Microsoft-Windows-PrintService/Admin",),
    "printservice-operational": ("Microsoft-Windows-PrintService/Operational",),
    "terminalservices-localsessionmanager": ("Microsoft-Windows-TerminalServices-LocalSessionManager/Operational",),
    "msexchange-management": ("MSExchange Management",),
    "appxdeployment-server": ("Microsoft-Windows-AppXDeploymentServer/Operational",),
    "shell-core": ("Microsoft-Windows-Shell-Core/Operational",),
    "openssh": ("OpenSSH/Operational",),
    "security-mitigations": ("Microsoft-Windows-Security-Mitigations/Kernel Mode", "Microsoft-Windows-Security-Mitigations/User Mode"),
    "applocker": ("Microsoft-Windows-AppLocker/EXE and DLL", "Microsoft-Windows-AppLocker/MSI and Script", "Microsoft-Windows-AppLocker/Packaged app-Deployment", "Microsoft-Windows-AppLocker/Packaged app-Execution"),
}
CATEGORIES: dict[str, tuple[str, ...]] = {
    "process_creation": ("Microsoft-Windows-Sysmon/Operational", "Security"),
    "network_connection": ("Microsoft-Windows-Sysmon/Operational",),
    "image_load": ("Microsoft-Windows-Sysmon/Operational",),
    "file_event": ("Microsoft-Windows-Sysmon/Operational",),
    "file_change": ("Microsoft-Windows-Sysmon/Operational",),
    "file_delete": ("Microsoft-Windows-Sysmon/Operational",),
    "file_rename": ("Microsoft-Windows-Sysmon/Operational",),
    "file_block": ("Microsoft-Windows-Sysmon/Operational",),
    "file_executable_detected": ("Microsoft-Windows-Sysmon/Operational",),
    "registry_event": ("Microsoft-Windows-Sysmon/Operational",),
    "registry_add": ("Microsoft-Windows-Sysmon/Operational",),
    "registry_delete": ("Microsoft-Windows-Sysmon/Operational",),
    "registry_set": ("Microsoft-Windows-Sysmon/Operational",),
    "registry_rename": ("Microsoft-Windows-Sysmon/Operational",),
    "process_access": ("Microsoft-Windows-Sysmon/Operational",),
    "dns_query": ("Microsoft-Windows-Sysmon/Operational",),
    "pipe_created": ("Microsoft-Windows-Sysmon/Operational",),
    "wmi_event": ("Microsoft-Windows-Sysmon/Operational",),
    "driver_load": ("Microsoft-Windows-Sysmon/Operational",),
    "create_remote_thread": ("Microsoft-Windows-Sysmon/Operational",),
    "raw_access_thread": ("Microsoft-Windows-Sysmon/Operational",),
    "create_stream_hash": ("Microsoft-Windows-Sysmon/Operational",),
    "clipboard_capture": ("Microsoft-Windows-Sysmon/Operational",),
    "process_tampering": ("Microsoft-Windows-Sysmon/Operational",),
    "sysmon_status": ("Microsoft-Windows-Sysmon/Operational",),
    "sysmon_error": ("Microsoft-Windows-Sysmon/Operational",),
    "ps_script": ("Microsoft-Windows-PowerShell/Operational",),
    "ps_module": ("Microsoft-Windows-PowerShell/Operational",),
    "ps_classic_start": ("Windows PowerShell",),
    "ps_classic_provider_start": ("Windows PowerShell",),
    "ps_classic_script": ("Windows PowerShell",),
}


def channels_of(source: Logsource) -> tuple[str, ...]:
    """The channels that a log source is read from; none if it names no known one. The service tells more than the category."""
    return SERVICES.get(source.service.lower()) or CATEGORIES.get(source.category.lower()) or ()


def in_channel(rule: Rule, channel: Column) -> Column:
    """Whether a rule applies to a channel; unknown sources and empty channels apply."""
    known = channels_of(rule.logsource)
    if not known:
        return F.lit(True)
    return channel.isNull() | (channel == "") | F.lower(channel).isin([k.lower() for k in known])
