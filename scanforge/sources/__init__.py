"""Sources and admission filters: file corpora, derived test views, manifests."""
