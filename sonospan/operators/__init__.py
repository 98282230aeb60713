"""Operators over tiers, signals and campaigns, as DataFrame transformations."""
