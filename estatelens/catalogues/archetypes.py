"""Solution shapes: which resource types prove which group name."""

from __future__ import annotations

from dataclasses import dataclass

GENERIC_TOKENS = ("shared", "core")


@dataclass(frozen=True)
class Archetype:
    """A shape is proved by any one anchor; ``signals_confirm`` also lets two or more
    supporting types prove it. There is no default: every entry must say which holds."""

    id: str
    token: str
    anchors: tuple[str, ...]
    signals_confirm: bool
    supporting: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    owned_ubiquitous: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.anchors:
            raise ValueError(f"archetype {self.id!r} has no anchor")
        if self.signals_confirm and not self.supporting:
            raise ValueError(f"archetype {self.id!r} confirms by signals but names none")
        if self.token in GENERIC_TOKENS:
            raise ValueError(f"archetype {self.id!r} claims a generic token")

    @property
    def needs_anchor(self) -> bool:
        return not self.signals_confirm or len(self.supporting) < MIN_SUPPORTING


def check_catalogue(entries: tuple[Archetype, ...]) -> tuple[Archetype, ...]:
    if not entries:
        raise ValueError("the archetype catalogue is empty")
    ids = [e.id for e in entries]
    twice = {i for i in ids if ids.count(i) > 1}
    if twice:
        raise ValueError(f"duplicate archetype ids: {sorted(twice)}")
    return entries


# --- fixed values: must equal the reference's for right results ---------------------

ANCHOR_WEIGHT = 2.0
STRONG_WEIGHT = 0.5
NEGATIVE_WEIGHT = 1.5
MIN_SCORE = 2.0
MIN_LEAD = 0.5
MIN_SUPPORTING = 2
MIN_SUPPORTING_LEAD = 1

UBIQUITOUS_TYPES = (
    "Microsoft.Storage/storageAccounts",
    "Microsoft.KeyVault/vaults",
    "Microsoft.Insights/components",
    "Microsoft.Insights/actionGroups",
    "Microsoft.ManagedIdentity/userAssignedIdentities",
)

ARCHETYPES = check_catalogue((
    Archetype(
        id="vm-workload", token="vm-workload", signals_confirm=False,
        anchors=("Microsoft.Compute/virtualMachines",),
        supporting=("Microsoft.Compute/disks", "Microsoft.Network/networkInterfaces",
                    "Microsoft.Compute/availabilitySets",
                    "Microsoft.Compute/virtualMachines/extensions"),
        negative=("Microsoft.ContainerService/managedClusters",),
    ),
    Archetype(
        id="web-app", token="web-app", signals_confirm=False,
        anchors=("Microsoft.Web/sites",),
        supporting=("Microsoft.Web/serverfarms",),
        generic=("Microsoft.Insights/components", "Microsoft.Storage/storageAccounts",
                 "Microsoft.KeyVault/vaults", "Microsoft.Sql/servers"),
        negative=("Microsoft.ContainerService/managedClusters",
                  "Microsoft.Network/azureFirewalls"),
    ),
    Archetype(
        id="aks-platform", token="aks-platform", signals_confirm=False,
        anchors=("Microsoft.ContainerService/managedClusters",),
        supporting=("Microsoft.ContainerRegistry/registries",),
        generic=("Microsoft.ManagedIdentity/userAssignedIdentities",
                 "Microsoft.Network/virtualNetworks", "Microsoft.Insights/components"),
    ),
    Archetype(
        id="network-hub", token="network-hub", signals_confirm=False,
        anchors=("Microsoft.Network/virtualNetworks",),
        supporting=("Microsoft.Network/routeTables", "Microsoft.Network/azureFirewalls",
                    "Microsoft.Network/networkSecurityGroups",
                    "Microsoft.Network/networkIntentPolicies",
                    "Microsoft.Network/publicIPAddresses"),
        negative=("Microsoft.Databricks/workspaces", "Microsoft.Synapse/workspaces",
                  "Microsoft.Web/sites", "Microsoft.Sql/servers",
                  "Microsoft.Compute/virtualMachines"),
    ),
    Archetype(
        id="backup", token="backup", signals_confirm=True,
        anchors=("Microsoft.RecoveryServices/vaults",
                 "Microsoft.DataProtection/backupVaults"),
        supporting=("Microsoft.Maintenance/maintenanceConfigurations",
                    "Microsoft.Compute/restorePointCollections"),
        generic=("Microsoft.Storage/storageAccounts",),
    ),
    Archetype(
        id="data-platform", token="data-platform", signals_confirm=False,
        anchors=("Microsoft.Databricks/workspaces", "Microsoft.Synapse/workspaces",
                 "Microsoft.DataFactory/factories"),
        supporting=("Microsoft.Databricks/accessConnectors",),
        generic=("Microsoft.Storage/storageAccounts",
                 "Microsoft.ManagedIdentity/userAssignedIdentities",
                 "Microsoft.KeyVault/vaults"),
    ),
    Archetype(
        id="sql-database", token="sql-db", signals_confirm=False,
        anchors=("Microsoft.Sql/servers",),
        supporting=("Microsoft.Sql/servers/databases",),
        generic=("Microsoft.Storage/storageAccounts", "Microsoft.KeyVault/vaults"),
        negative=("Microsoft.Web/sites",),
    ),
    Archetype(
        id="monitoring", token="monitoring", signals_confirm=True,
        anchors=("Microsoft.OperationalInsights/workspaces",
                 "Microsoft.Insights/actionGroups",
                 "Microsoft.AlertsManagement/actionRules",
                 "Microsoft.Insights/metricAlerts", "dynatrace.observability/monitors"),
        supporting=("Microsoft.Insights/activityLogAlerts",
                    "Microsoft.Insights/scheduledQueryRules"),
        generic=("Microsoft.Insights/components",),
        negative=("Microsoft.Web/sites", "Microsoft.DevCenter/devcenters"),
        owned_ubiquitous=("Microsoft.Insights/actionGroups",),
    ),
    Archetype(
        id="messaging", token="messaging", signals_confirm=False,
        anchors=("Microsoft.ServiceBus/namespaces", "Microsoft.EventHub/namespaces",
                 "Microsoft.EventGrid/topics"),
        generic=("Microsoft.Storage/storageAccounts",
                 "Microsoft.ManagedIdentity/userAssignedIdentities"),
    ),
    Archetype(
        id="identity", token="identity", signals_confirm=False,
        anchors=("Microsoft.ManagedIdentity/userAssignedIdentities",),
        negative=("Microsoft.Storage/storageAccounts", "Microsoft.Compute/virtualMachines",
                  "Microsoft.Databricks/workspaces", "Microsoft.Web/sites",
                  "Microsoft.Sql/servers", "Microsoft.Network/virtualNetworks"),
        owned_ubiquitous=("Microsoft.ManagedIdentity/userAssignedIdentities",),
    ),
    Archetype(
        id="devbox-platform", token="devbox", signals_confirm=False,
        anchors=("Microsoft.DevCenter/devcenters", "Microsoft.DevCenter/projects"),
        generic=("Microsoft.KeyVault/vaults", "Microsoft.Storage/storageAccounts",
                 "Microsoft.Insights/actionGroups"),
    ),
))
