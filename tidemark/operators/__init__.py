"""The table operators: profile, quality, transforms, contracts, findings, results, screening."""
