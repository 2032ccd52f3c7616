"""Writers of bundles, vaults and reports."""
