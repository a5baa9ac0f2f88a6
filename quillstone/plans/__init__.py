"""Named queries. Importing library fills the registry."""
